"""Vector code compression: eight parts, sixteen entries each, in whole numbers, by exponion search.

A part starts at the entry it had before. An entry as near as that one lies within twice that distance of it, so only the
neighbours up to there are looked at, from a list sorted by distance. All distances are exact squared whole numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idweave.llm.common import Staged
from idweave.operators.sizes import small

PARTS, ENTRIES, ROUNDS, STEPS = 8, 16, 6, 4096
BLOCK_COMPONENTS = 1 << 20
BLOCK_WRITE = {"parquet.page.size.row.check.min": "1"}  # rows are large
BLOCK = "ids binary, known binary, ints binary, codes binary, errors binary"


class Compressed(NamedTuple):
    codes: DataFrame
    codebooks: np.ndarray  #: by part, entry, place

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.codebooks.ravel().tolist())).encode()).hexdigest()


def nearest(x: np.ndarray, book: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of ``book`` to every row of x and its squared distance, of equals the first, by exponion search."""
    apart = ((book[:, None, :] - book[None, :, :]) ** 2).sum(2)
    code, least = before.copy(), np.empty(len(x), np.int64)
    order = np.argsort(before, kind="stable")
    ends = np.searchsorted(before[order], np.arange(len(book) + 1))
    for entry in range(len(book)):
        rows = order[ends[entry] : ends[entry + 1]]
        if not len(rows):
            continue
        own = ((x[rows] - book[entry]) ** 2).sum(1)
        rows = rows[np.argsort(-own, kind="stable")]
        own = -np.sort(-own)
        best, at = own.copy(), np.full(len(rows), entry)
        reach = -4 * own  # squared radius, falling
        for other in np.argsort(apart[entry], kind="stable").tolist():
            if other == entry:
                continue
            n = int(np.searchsorted(reach, -apart[entry, other], "right"))
            if n == 0:
                break  # all further neighbours lie beyond every radius
            new = ((x[rows[:n]] - book[other]) ** 2).sum(1)
            won = (new < best[:n]) | ((new == best[:n]) & (other < at[:n]))
            best[:n][won], at[:n][won] = new[won], other
        code[rows], least[rows] = at, best
    return code, least


def unpacked(batch: pa.RecordBatch, k: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    ints = np.frombuffer(batch["ints"][k].as_py(), np.int32).reshape(-1, dim)
    return ints, np.frombuffer(batch["codes"][k].as_py(), np.uint8).reshape(-1, PARTS)


def blocks(dim: int):
    """Blocks of vectors as whole numbers, every part at entry 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ints = batch["ints"].flatten().to_numpy().astype(np.int32).reshape(-1, dim)
            step = max(1, BLOCK_COMPONENTS // dim)
            for k in range(0, len(ints), step):
                own, ids = ints[k : k + step], batch["id"].slice(k, step)
                zero = np.zeros((len(own), PARTS), np.uint8)
                row = [ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), np.array(ids.is_valid(), bool), own, zero, np.zeros(len(own), np.int64)]
                labels = pa.array([batch["label"].slice(k, step).to_pylist()], pa.list_(batch.schema.field("label").type))
                yield pa.RecordBatch.from_arrays([*[pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in row], labels], ["ids", "known", "ints", "codes", "errors", "labels"])

    return run


def assigned(dim: int, books: np.ndarray):
    """Blocks with new codes and errors, by the parts' codebooks."""
    width = dim // PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors = [], []
            for k in range(batch.num_rows):
                ints, before = unpacked(batch, k, dim)
                own, error = before.copy(), np.zeros(len(ints), np.int64)
                for p in range(PARTS):
                    own[:, p], least = nearest(ints[:, p * width : (p + 1) * width].astype(np.int64), books[p], before[:, p])
                    error += least
                codes.append(own.tobytes())
                errors.append(error.tobytes())
            made = {"codes": pa.array(codes, pa.binary()), "errors": pa.array(errors, pa.binary())}
            yield pa.RecordBatch.from_arrays([made.get(n, batch[n]) for n in batch.schema.names], batch.schema.names)

    return run


def summed(dim: int, entries: int):
    """Of each part and entry the number and sums of a task's parts that have it."""
    width = dim // PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times, sums = np.zeros((PARTS, entries), np.int64), np.zeros((PARTS, entries, width), np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                ints, codes = unpacked(batch, k, dim)
                for p in range(PARTS):
                    times[p] += np.bincount(codes[:, p], minlength=entries)
                    np.add.at(sums[p], codes[:, p], ints[:, p * width : (p + 1) * width])
        p, e = (x.ravel() for x in np.meshgrid(np.arange(PARTS), np.arange(entries), indexing="ij"))
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(times.ravel()), pa.array(sums.reshape(-1, width).tolist(), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    return run


def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            ids, known, errors = (np.frombuffer(batch[c][k].as_py(), t) for c, t in (("ids", np.int64), ("known", bool), ("errors", np.int64)))
            digits = np.frombuffer(batch["codes"][k].as_py(), np.uint8).reshape(-1, PARTS)
            yield pa.RecordBatch.from_arrays([pa.array(ids, mask=~known), batch["labels"][k].values, pa.array([d.tobytes().hex() for d in digits]), pa.array(errors)], ["id", "label", "code", "error"])


def first_vectors(own: DataFrame) -> list[list[int]]:
    """Vectors of the least ids, one an id; passes over ids and vectors only, one where no id repeats."""
    found, last = [], None
    while len(found) < ENTRIES:
        rows = own.where("id is not null" if last is None else F.col("id") > last).orderBy("id", "ints").limit(ENTRIES).collect()
        for r in rows:
            if r["id"] != last:
                found.append(r["ints"])
                last = r["id"]
        if len(rows) < ENTRIES:
            break
    return found[:ENTRIES]


def compress(df: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label") -> Compressed:
    """id, code, error, label_error of all kept vectors, and the codebooks.

    Vectors that are null or hold null or non-finite components are left out, and so are those that cannot be cut into
    eight equal parts, that have another length than the kept vector of least id, or whose components are so large (for 64
    places over 46,000) that squared distances do not fit 64 bits. Codebooks start from the parts of the 16 least ids (null
    ids are none; of rows with one id the least vector counts; with fewer there are fewer entries). Repeated rows are
    vectors of their own. Null labels are summed together. Other columns are not read.

    Blocks of vectors, with their codes, are written once a round and replace the round's before; only codebooks, and
    sums of each entry's parts, pass through the driver: 16 entries of the vectors' length and their counts.
    """
    spark = df.sparkSession
    ints = F.transform(vector, lambda x: F.floor(x.cast("double") * STEPS))
    finite = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    sound = df.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & (F.size(vector) % PARTS == 0)).where(finite)
    limit = F.least(F.sqrt(F.lit(float(1 << 61)) / F.size(vector)), F.lit(float((1 << 31) - 1)))
    sound = sound.where(F.forall(vector, lambda x: F.abs(x.cast("double")) * STEPS < limit))
    own = sound.select(F.col(id).cast("long").alias("id"), F.col(label).alias("label"), ints.alias("ints"))
    dim = own.agg(F.min(F.struct(F.col("id").isNull(), "id", "ints")).alias("m")).select(F.size("m.ints")).first()[0]
    dim = dim if dim and dim > 0 else PARTS  # no vector at all
    own = own.where(F.size("ints") == dim)
    seeds = first_vectors(own) or [[0] * dim]
    books = np.array(seeds, np.int64).reshape(-1, PARTS, dim // PARTS).transpose(1, 0, 2).copy()
    kind = own.schema["label"].dataType.simpleString()
    schema = f"{BLOCK}, labels array<{kind}>"
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    spark.conf.set(batch, str(max(1, min(10_000, BLOCK_COMPONENTS // dim))))
    made = Staged(own.mapInArrow(blocks(dim), schema), "vectors", **BLOCK_WRITE)
    spark.conf.set(batch, "1")  # from here a row is a block
    for _ in range(ROUNDS):
        done = Staged(made.df.mapInArrow(assigned(dim, books), schema), "vectors", **BLOCK_WRITE)
        made.drop()
        made = done
        parts = made.df.mapInArrow(summed(dim, len(seeds)), "part int, entry int, n long, sums array<long>")
        each = parts.select("part", "entry", "n", F.posexplode("sums").alias("at", "x")).groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
        for r in each.collect():  # a row for each component of the codebooks
            if r["n"]:
                books[r["part"], r["entry"], r["at"]] = r["x"] // r["n"]
    last = made.df.mapInArrow(assigned(dim, books), schema)
    out = Staged(last.mapInArrow(coded, f"id long, label {kind}, code string, error long"), "codes").df
    made.drop()
    spark.conf.set(batch, before)
    by_label = small(out.groupBy("label").agg(F.sum("error").alias("label_error"))).alias("l")
    both = out.alias("o").join(by_label, F.col("o.label").eqNullSafe(F.col("l.label")))
    return Compressed(both.select(F.col("o.id").alias(id), "code", "error", "label_error"), books)
