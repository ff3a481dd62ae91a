"""N-gram Jaccard join with Bayesian candidate pruning.

Texts with equal sets of word shingles are one class. MinHash values in bands bring candidate classes into buckets;
their signatures are compared a few values at a time, and a pair is dropped as soon as the posterior probability that
its similarity reaches the threshold is below a tolerance. Candidate pairs left are gathered into components as
spanning forests, never as lists of pairs, and inside each component all pairs are pruned the same way and then
verified by exact intersections. Large buckets and components are cut into blocks, a task for each pair of blocks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from idweave.llm.common import Staged, components, map_text, small_batches
from idweave.llm.hnsw import forest
from idweave.llm.shingles import shingles

BANDS, ROWS = 32, 4  #: a pair at 0.8 shares no band with a probability under 5e-8
STEP = 16  #: signature values compared at a time
TOLERANCE = 1e-8  #: posterior probability under which a pair is dropped
BUCKET_BLOCK, COMPONENT_BLOCK = 2_048, 512
SMALL = 48  #: groups up to this size are compared together, all of one size at once
_dealt = np.random.Generator(np.random.PCG64(7))
A = _dealt.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
B = _dealt.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
MIX = _dealt.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)


def minhash(own: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(own), 2048):
        h = (A[:, None] * own[None, k : k + 2048] + B[:, None]) >> np.uint64(32)
        least = np.minimum(least, h.min(1).astype(np.uint32))
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    v = least.reshape(BANDS, ROWS).astype(np.uint64) * MIX
    h = v[:, 0]
    for k in range(1, ROWS):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + v[:, k]
    h ^= h >> np.uint64(32)
    return (h * np.uint64(0x94D049BB133111EB) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


@cache
def least_matches(least: float, tolerance: float = TOLERANCE) -> np.ndarray:
    """For each number of one-byte values compared, the fewest matches with which a pair lives on.

    A value matches with probability p = s + (1 - s) / 256; the prior of p is uniform, so its posterior is a beta
    distribution, whose upper tail is summed on a grid.
    """
    grid = (np.arange(20_000) + 0.5) / 20_000
    tail = grid >= least + (1 - least) / 256
    out = np.zeros(BANDS * ROWS + 1, int)
    for n in range(1, BANDS * ROWS + 1):
        for m in range(n + 1):
            log = m * np.log(grid) + (n - m) * np.log1p(-grid) + math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n - m + 1)
            if np.exp(log[tail]).mean() * tail.mean() >= tolerance:
                out[n] = m
                break
    return out


def surviving(sig: np.ndarray, a: np.ndarray, b: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Which of the pairs (a, b) of rows of sig are not dropped."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), np.int32)
    for k in range(0, sig.shape[1], STEP):
        for c in range(0, len(alive), 1 << 18):
            part = alive[c : c + (1 << 18)]
            matches[part] += (sig[a[part], k : k + STEP] == sig[b[part], k : k + STEP]).sum(1, dtype=np.int32)
        alive = alive[matches[alive] >= bound[min(k + STEP, sig.shape[1])]]
    return alive


def pairs_of(sizes: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs within runs of rows, a bounded number at a time."""
    for size in np.unique(sizes).tolist():
        at = starts[sizes == size]
        if size <= SMALL:
            i, j = np.triu_indices(size, 1)
            step = max(1, (1 << 20) // max(1, len(i)))
            for k in range(0, len(at), step):
                yield (at[k : k + step, None] + i).ravel(), (at[k : k + step, None] + j).ravel()
        else:
            for start in at.tolist():
                for k in range(0, size, 256):
                    i, j = np.meshgrid(np.arange(k, min(size, k + 256)), np.arange(k, size), indexing="ij")
                    up = j > i
                    yield start + i[up], start + j[up]


def runs(batches: Iterator[pa.RecordBatch], most_rows: int = 1 << 14) -> Iterator[pa.Table]:
    """Batches sorted by their first column as tables that hold whole runs of it."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        key = batch.column(0)
        if rows >= most_rows:
            last = key.to_numpy(zero_copy_only=False)
            cut = int(np.searchsorted(last, last[-1]))
            if cut:
                yield pa.Table.from_batches([*held[:-1], batch.slice(0, cut)])
                held, rows = [batch.slice(cut)], batch.num_rows - cut
    if held:
        yield pa.Table.from_batches(held)


def bytes_matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def bounds(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return starts, np.diff(np.append(starts, len(keys)))


def candidates(least: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bound = least_matches(least)
        for t in runs(batches):
            keys, cross = t["g"].to_numpy(), t["cross"].to_numpy()
            ids, side, sig = t["rep"].to_numpy(), t["side"].to_numpy(), bytes_matrix(t["sig"], BANDS * ROWS)
            starts, sizes = bounds(keys)
            more = sizes > 1
            a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for i, j in pairs_of(sizes[more], starts[more]):
                ok = ~cross[i] | (side[i] != side[j])
                i, j = i[ok], j[ok]
                s = surviving(sig, i, j, bound)
                pair = np.unique(np.column_stack([ids[i[s]], ids[j[s]]]), axis=0)
                a.append(pair[:, 0])
                b.append(pair[:, 1])
            tree = forest(np.concatenate(a), np.concatenate(b))
            out = [(x, y) for x, y in tree.items() if x != y]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["src", "dst"])

    return run


def common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of incidence matrices over the elements that two sets or more hold."""
    m = len(sets)
    row = np.repeat(np.arange(m), [len(s) for s in sets])
    _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    number = np.cumsum(shared) - 1
    keep = shared[at]
    row, col = row[keep], number[at[keep]]
    order = np.argsort(col, kind="stable")
    row, col, out = row[order], col[order], np.zeros((m, m), np.float32)
    width = max(1, (1 << 23) // max(1, m))
    for k in range(0, int(shared.sum()), width):
        lo, hi = np.searchsorted(col, [k, k + width])
        cells = np.zeros((m, width), np.float32)
        cells[row[lo:hi], col[lo:hi] - k] = 1
        out += cells @ cells.T
    return out


def verified(least: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bound = least_matches(least)
        for t in runs(batches, 2048):
            keys = t["g"].to_numpy()
            starts, sizes = bounds(keys)
            for start, size in zip(starts.tolist(), sizes.tolist()):
                own = t.slice(start, size)
                own = own.take(np.sort(np.unique(own["rep"].to_numpy(), return_index=True)[1]))  # a repeated row counts in times
                size = own.num_rows
                ids, times, side, cross = own["rep"].to_numpy(), own["times"].to_numpy(), own["side"].to_numpy(), own["cross"][0].as_py()
                sig, sets = bytes_matrix(own["sig"], BANDS * ROWS), [np.frombuffer(x, np.uint64) for x in own["own"].to_pylist()]
                n, linked = np.zeros(size, np.int64), [np.empty((0, 2), np.int64)]
                shared = common(sets) if size > 8 else None
                for i, j in pairs_of(np.array([size]), np.array([0])):
                    if cross:
                        ok = side[i] != side[j]
                        i, j = i[ok], j[ok]
                    s = surviving(sig, i, j, bound)
                    i, j = i[s], j[s]
                    both = shared[i, j] if shared is not None else np.array([len(np.intersect1d(sets[x], sets[y], True)) for x, y in zip(i.tolist(), j.tolist())])
                    either = np.array([len(s) for s in sets])[i] + np.array([len(s) for s in sets])[j] - both
                    real = both >= least * either - 1e-9
                    i, j = i[real], j[real]
                    np.add.at(n, i, times[j])
                    np.add.at(n, j, times[i])
                    linked.append(np.column_stack([ids[i], ids[j]]))
                pair = np.concatenate(linked)
                tree = forest(pair[:, 0], pair[:, 1])
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([tree.get(x, x) for x in ids.tolist()], pa.int64()), pa.array(n)], ["node", "root", "n"])

    return run


def blocked(df: DataFrame, key: str, size: str, block: int) -> DataFrame:
    """df with g, side and cross: groups beyond ``block`` rows are cut in blocks by id, a group g for each pair of blocks."""
    parts = F.ceil(F.col(size) / block).cast("int")
    own = F.pmod(F.xxhash64("rep", F.lit(3)), parts).cast("int")
    others = F.when(parts > 1, F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.lit(0)))
    rows = df.withColumn("side", F.when(parts > 1, own).otherwise(0)).withColumn("other", F.explode(others))
    low, high = F.least("side", "other"), F.greatest("side", "other")
    return rows.withColumn("g", F.when(parts > 1, F.xxhash64(key, low, high)).otherwise(F.col(key))).withColumn("cross", low != high).drop("other", size)


def near_documents(df: DataFrame, id: str = "doc_id", text: str = "text", words: int = 5, least: float = 0.8) -> DataFrame:
    """A row for each row of df: id, class_id, n_links, component_id, kept.

    Two texts are linked when the Jaccard similarity of their sets of runs of ``words`` lower-case words is ``least`` or
    more. class_id is the least id whose text has the same set; n_links counts the other rows linked, copies included;
    component_id is the least id reachable by links; kept marks it. Texts of fewer words have one run, all they have;
    null texts and texts without a word link with nothing and are a class and a component of their own. An id names one
    text; repeated rows are copies. Other columns of df are dropped, whatever their names.
    """
    spark = df.sparkSession
    small_batches(spark)
    rows = df.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))

    def measure(texts: list[str | None]) -> tuple[list, ...]:
        keys, bands, sigs = [], [], []
        for t in texts:
            own = shingles(t, words)
            m = minhash(own)
            keys.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
            bands.append(band_keys(m).tolist() if len(own) else None)
            sigs.append(m.astype(np.uint8).tobytes() if len(own) else None)
        return keys, bands, sigs

    extra = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sig", T.BinaryType())])
    sized = Staged(map_text(rows, "text", extra, measure).drop("text"), "signatures").df
    classes = sized.where("key is not null").groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("times"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    classes = Staged(classes, "classes").df

    band = classes.select("rep", F.explode("bands").alias("b"))
    shared = Staged(band.groupBy("b").agg(F.count("*").alias("n")).where("n > 1"), "buckets").df
    members = blocked(band.join(shared, "b"), "b", "n", BUCKET_BLOCK).join(classes.select("rep", "sig"), "rep")
    gathered = members.select("g", "cross", "rep", "side", "sig").repartition("g").sortWithinPartitions("g")
    rough = components(gathered.mapInArrow(candidates(least), "src long, dst long"))

    size = rough.groupBy("component").agg(F.count("*").alias("m"))
    there = rough.join(size, "component").withColumnRenamed("node", "rep").join(classes.select("rep", "times", "sig"), "rep")
    there = Staged(there.select("rep", "component", "m", "times", "sig"), "near").df

    def sets(texts: list[str | None]) -> tuple[list, ...]:
        return ([shingles(t, words).tobytes() for t in texts],)

    own = map_text(rows.join(there, F.col("id") == F.col("rep")).select("rep", "component", "m", "times", "sig", "text"), "text", T.StructType([T.StructField("own", T.BinaryType())]), sets).drop("text")
    own = Staged(own, "sets").df
    gathered = blocked(own, "component", "m", COMPONENT_BLOCK).select("g", "cross", "rep", "side", "times", "sig", "own").repartition("g").sortWithinPartitions("g")
    links = Staged(gathered.mapInArrow(verified(least), "node long, root long, n long"), "links").df
    joined = components(links.select(F.col("node").alias("src"), F.col("root").alias("dst")))
    count = links.groupBy("node").agg(F.sum("n").alias("n"))
    known = classes.select("key", "rep", "times").join(count.withColumnRenamed("node", "rep"), "rep", "left").join(joined.toDF("rep", "component"), "rep", "left")
    known = known.select("key", F.col("rep").alias("class_id"), (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = sized.select("id", "key").join(known, "key", "left")
    own_id: Column = F.col("id")
    out = out.select(own_id.alias(id), F.coalesce("class_id", own_id).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", own_id).alias("component_id"))
    return out.withColumn("kept", F.col(id) == F.col("component_id"))
