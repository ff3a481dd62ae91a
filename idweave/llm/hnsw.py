"""Near-duplicate vectors by hierarchical navigable small-world graphs, one a shard.

Each group of comparable vectors is dealt into shards of bounded size, and a task builds a graph for each. The beam that
a graph needs is measured when it is built: vectors at the threshold from sampled nodes must find these nodes. Every
block of vectors goes to every shard of its group, some blocks to each copy of a graph; beams widen while they are full of
links, and again for a whole block until an audit against brute force finds all it should. Links are verified by cosine
in double precision, counted where they are found, and leave the task only as a spanning forest, which a distributed
union joins across shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idweave.llm.common import Staged, components

SHARD_ROWS = 20_000  #: vectors of a shard; a task's memory follows from it
BLOCK_ROWS = 2_048  #: queries of a task's row
DEGREE = 12  #: neighbours chosen for a new node; a node keeps up to twice as many
BUILD_BEAM, FIRST_BEAM = 32, 24
BATCH = 256
BLOCKS = 16  #: that a copy of a graph answers; a task's memory follows from it
PROBES = 256  #: of each graph, near sampled nodes
AUDIT_QUERIES = 48  #: of each block and shard, compared with brute force
AUDIT_RECALL = 0.999
SLACK = 1e-3  #: beams work in single precision; what is this close to the threshold is verified in double


class Graph:
    """Layer k holds the first ``sizes[k]`` vectors; links[k] their neighbours, -1 where there is none."""

    def __init__(self, vectors: np.ndarray, links: list[np.ndarray] | None = None):
        self.x = vectors.astype(np.float32)
        n, self.sizes = len(vectors), []
        while True:
            self.sizes.append(n)
            if n <= 2 * DEGREE:
                break
            n //= 16
        self.links = links or [np.full((n, 2 * DEGREE), -1, np.int32) for n in self.sizes]
        if links is None:
            for layer in range(len(self.sizes) - 1, -1, -1):
                self._build(layer)

    def _build(self, layer: int) -> None:
        n, at = self.sizes[layer], min(self.sizes[layer], DEGREE)
        for k in range(at):
            self.links[layer][k, : at - 1] = [j for j in range(at) if j != k]
        while at < n:
            end = min(n, at + max(16, min(BATCH, at // 2)))
            self._insert(layer, np.arange(at, end), at)
            at = end

    def _insert(self, layer: int, new: np.ndarray, done: int) -> None:
        q, links = self.x[new], self.links[layer]
        start = self._descend(q, layer)
        ids, sims = self._beam(q, layer, np.where(start < done, start, 0), BUILD_BEAM, done)
        own = q @ q.T
        np.fill_diagonal(own, -2)
        near = np.argsort(-own, axis=1)[:, :DEGREE]
        ids = np.concatenate([ids, new[near]], 1)
        sims = np.concatenate([sims, np.take_along_axis(own, near, 1)], 1)
        chosen = self._select(ids, sims, DEGREE)
        links[new, :DEGREE] = chosen
        src, dst = np.repeat(new, DEGREE), chosen.ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        nodes, first, times = np.unique(dst, return_index=True, return_counts=True)
        column = np.arange(len(dst)) - np.repeat(first, times)
        more = np.full((len(nodes), min(int(times.max(initial=0)), 4 * DEGREE)), -1, np.int32)
        fits = column < more.shape[1]
        more[np.repeat(np.arange(len(nodes)), times)[fits], column[fits]] = src[fits]
        ids = np.concatenate([links[nodes], more], 1)
        sims = np.einsum("nkd,nd->nk", self.x[ids], self.x[nodes])
        sims[ids < 0] = -2
        links[nodes] = self._select(ids, sims, 2 * DEGREE)

    def _select(self, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Of each row's candidates, best first: those nearer to the node than to any chosen one, then the rest."""
        order = np.argsort(-sims, axis=1, kind="stable")[:, : 4 * DEGREE]
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        bad = (ids < 0) | (sims <= -2)
        among = self.x[ids]
        among = among @ among.transpose(0, 2, 1)
        chosen, n = np.zeros(ids.shape, bool), np.zeros(len(ids), int)
        for k in range(ids.shape[1]):
            take = ~bad[:, k] & (n < most)
            if k:
                twin = ((ids[:, :k] == ids[:, k : k + 1]) & ~bad[:, :k]).any(1)
                bad[twin, k] = True
                take &= ~twin & ~(chosen[:, :k] & (among[:, k, :k] > sims[:, k : k + 1])).any(1)
            chosen[:, k] = take
            n += take
        rank = np.where(bad, 2, np.where(chosen, 0, 1))
        order = np.argsort(rank, axis=1, kind="stable")[:, :most]
        out = np.where(np.take_along_axis(bad, order, 1), -1, np.take_along_axis(ids, order, 1)).astype(np.int32)
        return out if out.shape[1] == most else np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)

    def _descend(self, q: np.ndarray, layer: int) -> np.ndarray:
        at = np.zeros(len(q), np.int64)
        for k in range(len(self.sizes) - 1, layer, -1):
            at = self._beam(q, k, at, 4, self.sizes[k])[0][:, 0]
        return at

    def _beam(self, q: np.ndarray, layer: int, start: np.ndarray, beam: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """All queries in step: each expands its best open nodes, an eighth of the beam, until it has none. Ids and cosines, best first."""
        rows, wide = np.arange(len(q)), max(3, beam // 8)
        ids, sims = np.full((len(q), beam), -1, np.int64), np.full((len(q), beam), -2, np.float32)
        open_ = np.zeros((len(q), beam), bool)
        seen = np.zeros((len(q), n), bool)
        ids[:, 0], sims[:, 0], open_[:, 0] = start, np.einsum("nd,nd->n", q, self.x[start]), True
        seen[rows, start] = True
        live = rows
        while len(live):
            value = np.where(open_[live], sims[live], -3)
            best = np.argsort(-value, axis=1)[:, :wide]
            valid = np.take_along_axis(value, best, 1) > -3
            here = np.take_along_axis(ids[live], best, 1)
            np.put_along_axis(mark := open_[live], best, False, 1)
            open_[live] = mark
            next_ = np.where(valid[:, :, None], self.links[layer][here], -1).reshape(len(live), -1)
            next_ = np.sort(next_, 1)
            fresh = (next_ >= 0) & ~seen[live[:, None], next_]
            fresh[:, 1:] &= next_[:, 1:] != next_[:, :-1]
            r, c = np.nonzero(fresh)
            seen[live[r], next_[r, c]] = True
            s = np.full(next_.shape, -2, np.float32)
            s[r, c] = np.einsum("nd,nd->n", self.x[next_[r, c]], q[live[r]])
            all_ids = np.concatenate([ids[live], np.where(fresh, next_, -1)], 1)
            all_sims, all_open = np.concatenate([sims[live], s], 1), np.concatenate([open_[live], fresh], 1)
            keep = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            ids[live], sims[live], open_[live] = (np.take_along_axis(a, keep, 1) for a in (all_ids, all_sims, all_open))
            live = live[open_[live].any(1)]
        order = np.argsort(-sims, axis=1)
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def needed_beam(self, least: float) -> int:
        """The beam, doubled from ``FIRST_BEAM``, with which vectors at cosine ``least`` from sampled nodes find these nodes."""
        rng = np.random.Generator(np.random.PCG64(1))
        at = np.unique(np.linspace(0, len(self.x) - 1, min(PROBES, len(self.x))).astype(int))
        away = rng.normal(size=(len(at), self.x.shape[1]))
        away -= self.x[at] * (away * self.x[at]).sum(1, keepdims=True)
        length = np.sqrt((away * away).sum(1, keepdims=True))
        probes = least * self.x[at] + np.sqrt(max(0.0, 1 - least * least)) * np.divide(away, length, out=np.zeros_like(away), where=length > 1e-9)
        beam, probes = FIRST_BEAM, probes.astype(np.float32)
        while beam < len(self.x) and (self._beam(probes, 0, self._descend(probes, 0), beam, len(self.x))[0] == at[:, None]).any(1).mean() < AUDIT_RECALL:
            beam *= 2
        return beam

    def within(self, q: np.ndarray, least: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, node) of cosine ``least`` or more; a beam that is full of such pairs is doubled.

        A beam as large as the shard is all of it.
        """
        q, found, rows = q.astype(np.float32), [], np.arange(len(q))
        while len(rows):
            if beam >= len(self.x):
                found.append(self.all_within(q, rows, least))
                break
            again = []
            for k in range(0, len(rows), BATCH):
                part = rows[k : k + BATCH]
                ids, sims = self._beam(q[part], 0, self._descend(q[part], 0), beam, len(self.x))
                full = sims[:, -1] >= least
                r, c = np.nonzero((sims >= least) & (ids >= 0) & ~full[:, None])
                found.append((part[r], ids[r, c]))
                again.append(part[full])
            rows, beam = np.concatenate(again), beam * 2
        return tuple(map(np.concatenate, zip(*found))) if found else (np.empty(0, int), np.empty(0, int))

    def all_within(self, q: np.ndarray, rows: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        parts = [(part, np.nonzero(q[part] @ self.x.T >= least)) for k in range(0, len(rows), BATCH) for part in [rows[k : k + BATCH]]]
        return np.concatenate([part[r] for part, (r, _) in parts]), np.concatenate([c for _, (_, c) in parts])


def links_of(graph: Graph, nodes: np.ndarray, queries: np.ndarray, least: float, beam: int = FIRST_BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Verified pairs of a block with a shard, both in unit vectors of double precision; beams widen until the audit passes."""
    audit = np.unique(np.linspace(0, len(queries) - 1, min(AUDIT_QUERIES, len(queries))).astype(int))
    truth = (queries[audit] @ nodes.T >= least).sum()
    while True:
        q, v = graph.within(queries, least - SLACK, beam)
        real = np.concatenate([np.einsum("nd,nd->n", queries[q[k : k + 65536]], nodes[v[k : k + 65536]]) >= least for k in range(0, len(q), 65536)] or [np.empty(0, bool)])
        q, v = q[real], v[real]
        if beam >= len(nodes) or np.isin(q, audit).sum() >= AUDIT_RECALL * truth:
            return q, v
        beam *= 4


def forest(a: np.ndarray, b: np.ndarray) -> dict[int, int]:
    """Each node of the pairs with its tree's least node."""
    top: dict[int, int] = {}

    def find(x: int) -> int:
        while top.setdefault(x, x) != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = find(x), find(y)
        if x != y:
            top[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(top)}


def unit(blob: bytes, dim: int) -> np.ndarray:
    x = np.frombuffer(blob, np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


BUILT = "dim int, shard int, block int, beam int, ids binary, times binary, vectors binary, links array<binary>"


def build(least: float):
    """A row with the shard's graph (block -1), and a row for each block of its vectors."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "rep"])  # by hash: the upper layers hold a sample
        grp, dim, shard = pdf.grp.iloc[0], int(pdf.dim.iloc[0]), int(pdf.shard.iloc[0])
        ids, times = pdf.rep.to_numpy(np.int64), pdf.times.to_numpy(np.int64)
        x = np.stack(pdf.vec.to_numpy()).astype(np.float64)
        graph = Graph(unit(x.tobytes(), dim))
        rows = [(grp, dim, shard, -1, graph.needed_beam(least), ids.tobytes(), times.tobytes(), x.tobytes(), [a.tobytes() for a in graph.links])]
        for k in range(0, len(ids), BLOCK_ROWS):
            rows.append((grp, dim, shard, k // BLOCK_ROWS, 0, ids[k : k + BLOCK_ROWS].tobytes(), b"", x[k : k + BLOCK_ROWS].tobytes(), []))
        return pd.DataFrame(rows, columns=["grp", *(c.split()[0] for c in BUILT.split(", "))])

    return run


def search(least: float):
    def run(graphs: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"node": np.empty(0, np.int64), "root": np.empty(0, np.int64), "n": np.empty(0, np.int64)})]
        for r in graphs.itertuples():
            nodes, ids, times = unit(r.vectors, r.dim), np.frombuffer(r.ids, np.int64), np.frombuffer(r.times, np.int64)
            graph = Graph(nodes, [np.frombuffer(a, np.int32).reshape(-1, 2 * DEGREE) for a in r.links])
            for block in blocks.itertuples():
                q_ids = np.frombuffer(block.q_ids, np.int64)
                q, v = links_of(graph, nodes, unit(block.q_vectors, r.dim), least, r.beam)
                other = q_ids[q] != ids[v]
                q, v = q[other], v[other]
                count = dict(zip(q_ids.tolist(), np.bincount(q, times[v], len(q_ids)).astype(np.int64).tolist()))
                tree = forest(q_ids[q], ids[v])
                node = np.fromiter(tree, np.int64, len(tree))
                out.append(pd.DataFrame({"node": node, "root": np.fromiter(tree.values(), np.int64, len(tree)), "n": np.fromiter((count.get(x, 0) for x in tree), np.int64, len(tree))}))
        return pd.concat(out, ignore_index=True)

    return run


def near_vectors(df: DataFrame, id: str = "vec_id", vector: str = "embedding", group: str = "label", least: float = 0.98, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """A row for each row of df: id, n_links, component_id, kept.

    Vectors are compared when their groups are equal and not null and their lengths are equal. Null, empty and zero
    vectors and those with null or non-finite components link with nothing and are their own component. Equal vectors
    of a group are one node with a multiplicity, so a large group of copies costs one search; each copy counts as a
    link of the others. Repeated rows are copies as well. Other columns of df are dropped, whatever their names.
    """
    kind = df.select(group).schema[0].dataType.simpleString()
    vec = F.transform(F.col(vector), lambda x: x.cast("double"))
    sound = F.forall(F.col("vec"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(F.col("vec"), lambda x: x != 0)
    rows = df.select(F.col(id).cast("long").alias("id"), F.col(group).alias("grp"), vec.alias("vec"))
    rows = rows.select("id", "grp", F.when(F.col("grp").isNotNull() & F.coalesce(sound, F.lit(False)), F.col("vec")).alias("vec"))
    rows = rows.withColumn("dim", F.size("vec")).withColumn("k", F.when(F.col("vec").isNotNull(), F.xxhash64("vec")))
    valid = rows.where("vec is not null")
    reps = Staged(valid.groupBy("grp", "dim", "k", "vec").agg(F.min("id").alias("rep"), F.count("*").alias("times")), "reps").df
    shards = reps.groupBy("grp", "dim").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("n"))
    dealt = reps.join(shards, ["grp", "dim"]).select("grp", "dim", "rep", "times", "vec", F.xxhash64("rep").alias("h"), F.pmod(F.xxhash64("rep", F.lit(1)), "n").cast("int").alias("shard"))
    built = Staged(dealt.groupBy("grp", "dim", "shard").applyInPandas(build(least), f"grp {kind}, {BUILT}"), "graphs").df
    # blocks go to the shards, a copy of the graph for some of them each; the key is dealt out before anything is copied
    size = built.where("block >= 0").groupBy("grp", "dim").agg((F.max("shard") + 1).alias("n"), F.ceil(F.count("*") / BLOCKS).cast("int").alias("salts"))
    sized = built.join(size, ["grp", "dim"])
    graphs = sized.where("block < 0").select("grp", "dim", "shard", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "beam", "ids", "times", "vectors", "links")
    salt = F.pmod(F.xxhash64("shard", "block"), "salts").cast("int").alias("q_salt")
    blocks = sized.where("block >= 0").select(F.col("grp").alias("q_grp"), F.col("dim").alias("q_dim"), salt, F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("q_shard"))
    both = graphs.groupBy("grp", "dim", "shard", "salt").cogroup(blocks.groupBy("q_grp", "q_dim", "q_shard", "q_salt"))
    found = Staged(both.applyInPandas(search(least), "node long, root long, n long"), "links").df
    joined = components(found.select(F.col("node").alias("src"), F.col("root").alias("dst")))
    count = found.groupBy("node").agg(F.sum("n").alias("n"))
    known = reps.join(count.withColumnRenamed("node", "rep"), "rep", "left").join(joined.toDF("rep", "component"), "rep", "left")
    known = known.select("grp", "dim", "k", "vec", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n"), F.coalesce("component", "rep").alias("component"))
    out = valid.join(known, ["grp", "dim", "k", "vec"]).select("id", "n", "component")
    out = out.unionByName(rows.where("vec is null").select("id", F.lit(0).cast("long").alias("n"), F.col("id").alias("component")))
    return out.select(F.col("id").alias(id), F.col("n").cast("long").alias("n_links"), F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))
