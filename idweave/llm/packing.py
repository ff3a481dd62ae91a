"""Packing documents into token sequences by cutting-stock column generation.

What exceeds whole sequences of a document is a remainder. A histogram of remainder lengths, of fixed size, goes to the
driver, where a linear program over packing patterns is solved by column generation: a knapsack dynamic program prices
new patterns. Rounded-down pattern counts become slots, remainders are ranked within their length class on Spark, and
ranks are matched to slots. Remainders left over are cut to fill the gaps that length classes leave, end to end along
one axis of tokens, and what is left of them fills sequences of its own, the last ones powers of two long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from idweave.llm.common import Staged, small_batches
from idweave.llm.word_ids import word_ids

SEQUENCE = 2_048
UNIT = 16  #: remainder lengths count in classes of so many tokens
END_ID = 1
ROWS_PER_PART = 200_000  #: of a window that ranks or sums
AXIS_BLOCK = 1 << 16
GAP = 0.002
RESERVE = 1.1  #: left-over tokens planned for, as a multiple of what gaps will take


def best_pattern(value: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the counts of each size (ascending) that have the largest value within the capacity."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    upto = np.searchsorted(sizes, np.arange(capacity + 1), "right").tolist()
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if n := upto[c]:
            gain = best[c - sizes[:n]] + value[:n]
            k = int(gain.argmax())
            if gain[k] > best[c] + 1e-12:
                best[c], last[c] = gain[k], k
    counts, c = np.zeros(len(sizes), int), capacity
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            counts[last[c]] += 1
            c -= int(sizes[last[c]])
    return float(best[capacity]), counts


def cutting_stock(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 4_000) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (columns) and how often each is used, a fraction, so that the fewest bins meet the demand.

    Revised simplex from one-size patterns; each round the duals price the best new pattern, until none has a reduced
    cost below zero or the bound that prices give (objective / best value) is within ``GAP``: what patterns leave over
    is cut into gaps anyway. Any round's basis is a usable answer, so rounds are bounded; slightly unequal demands keep
    degenerate pivots from cycling, and a step of Newton's method now and then keeps the inverse from drifting.
    """
    n = len(sizes)
    demand = demand * (1 - 1e-6 * np.random.Generator(np.random.PCG64(2)).random(n))
    basis = np.diag(capacity // sizes).astype(float)
    inverse = np.diag(1 / np.diag(basis))
    x = inverse @ demand
    for k in range(rounds):
        value, new = best_pattern(inverse.sum(0), sizes, capacity)
        if value <= 1 + GAP:
            break
        direction = inverse @ new
        up = direction > 1e-9
        ratio = np.full(n, np.inf)
        ratio[up] = x[up] / direction[up]
        out = int(ratio.argmin())
        step = ratio[out]
        x = x - step * direction
        x[out] = step
        basis[:, out] = new
        row = inverse[out] / direction[out]
        inverse = inverse - np.outer(direction, row)
        inverse[out] = row
        if k % 200 == 199:
            inverse = 2 * inverse - np.einsum("ij,jk->ik", np.einsum("ij,jk->ik", inverse, basis), inverse)
            x = np.maximum(inverse @ demand, 0)
    return basis.astype(int), np.maximum(x, 0)


def plan(histogram: dict[int, tuple[int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Slots from a histogram {class: (remainders, tokens)}: class, first rank, last rank + 1, copies in a sequence, first sequence."""
    sizes = np.array(sorted(histogram), int)
    if not len(sizes):
        return []
    demand = np.array([histogram[b][0] for b in sizes.tolist()], float)
    tokens = sum(t for _, t in histogram.values())
    patterns, times = cutting_stock(sizes, demand, SEQUENCE // UNIT)
    gap = (times * (SEQUENCE - UNIT * (sizes @ patterns))).sum() + (UNIT * (sizes * demand).sum() - tokens)
    counts = np.floor(times * (1 - min(1.0, RESERVE * gap / (gap + tokens))) + 1e-9).astype(int)
    slots, ranks, sequence = [], np.zeros(len(sizes), int), 0
    for column, n in zip(patterns.T, counts.tolist()):
        for k in np.flatnonzero(column).tolist():
            copies = int(column[k])
            if n:
                slots.append((int(sizes[k]), int(ranks[k]), int(ranks[k]) + n * copies, copies, sequence))
            ranks[k] += n * copies
        sequence += n
    return slots


def running(df: DataFrame, value: Column, out: str, parts: int, keys: list[str], order: list[str]) -> DataFrame:
    """df with ``out``: the sum of value over the rows before, within ``keys``; windows hold a part of a key's rows."""
    dealt = df.withColumn("part", F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int")).withColumn("value", value)
    own = Window.partitionBy(*keys, "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(*keys, "part").agg(F.sum("value").alias("s"))
    before = sums.withColumn("before", F.coalesce(F.sum("s").over(whole), F.lit(0))).drop("s")
    summed = dealt.withColumn("within", F.coalesce(F.sum("value").over(own), F.lit(0)))
    return summed.join(F.broadcast(before) if parts <= 1_000 else before, [*keys, "part"]).withColumn(out, (F.col("within") + F.col("before")).cast("long")).drop("within", "before", "value", "part")


def aligned(fillers: DataFrame, gaps: DataFrame) -> DataFrame:
    """Pieces of fillers (row, start, at, n) in gaps (sequence_id, offset, at, n), both laid end to end along one axis."""
    block = F.explode(F.sequence(F.floor(F.col("at") / AXIS_BLOCK), F.floor((F.col("at") + F.col("n") - 1) / AXIS_BLOCK))).alias("block")
    none = lambda df: F.lit(None).cast(df)
    f = fillers.select(F.struct("row", "start", "at", "n").alias("f"), "at", block)
    g = gaps.select(F.struct("sequence_id", "offset", "at", "n").alias("g"), "at", block)
    events = f.withColumn("g", none(g.schema["g"].dataType)).unionByName(g.withColumn("f", none(f.schema["f"].dataType)))
    events = events.withColumn("pos", F.greatest("at", F.col("block") * AXIS_BLOCK))
    order = Window.partitionBy("block").orderBy("pos", F.col("f").isNull())
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = events.withColumn("next", F.lead("pos").over(order)).withColumn("f", F.last("f", True).over(so_far)).withColumn("g", F.last("g", True).over(so_far))
    end = F.least(F.coalesce("next", (F.col("block") + 1) * AXIS_BLOCK), F.col("f.at") + F.col("f.n"), F.col("g.at") + F.col("g.n"))
    rows = rows.where("f is not null and g is not null").withColumn("length", end - F.col("pos")).where("length > 0")
    at = lambda s: F.col("pos") - F.col(f"{s}.at")
    return rows.select("f.row", (F.col("f.start") + at("f")).alias("start"), "length", "g.sequence_id", (F.col("g.offset") + at("g")).alias("offset"))


def tokens(df: DataFrame, path: str, id: str, text: str) -> DataFrame:
    """Row number, id, number of ids with the closing one, and the ids without it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = word_ids(path)
        for batch in batches:
            ids = [own.encode(x.as_py()) for x in batch.column(2)]
            n = [len(x) // np.dtype(own.width).itemsize + 1 for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], ["row", "id", "n", "ids"])

    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "row long, id long, n long, ids binary")


def pieces_of(spark: SparkSession, lengths: DataFrame) -> DataFrame:
    """Pieces (row, start, length, sequence_id, offset) of documents (row, n)."""
    rest = (F.col("n") % SEQUENCE).alias("r")
    left = lengths.select("row", (F.col("n") - rest).alias("start"), rest.cast("long").alias("r")).where("r > 0").withColumn("b", F.ceil(F.col("r") / UNIT).cast("int"))
    histogram = {r["b"]: (r["n"], r["t"]) for r in left.groupBy("b").agg(F.count("*").alias("n"), F.sum("r").alias("t")).collect()}  # SEQUENCE / UNIT rows at most
    slots = plan(histogram)
    n_left = sum(n for n, _ in histogram.values())
    parts = max(32, -(-n_left // ROWS_PER_PART))
    table = spark.createDataFrame(slots, "b int, low long, high long, copies long, base long")
    ranked = running(left, F.lit(1), "rank", parts, ["b"], ["row"])
    placed = ranked.join(F.broadcast(table.withColumnRenamed("b", "tb")), (F.col("b") == F.col("tb")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")), "left")
    at = F.col("rank") - F.col("low")
    placed = placed.select("row", "start", "r", "b", F.floor(F.col("base") + at / F.col("copies")).alias("sequence_id"), (at % F.col("copies")).alias("copy"))
    placed = Staged(placed, "placed").df
    within = Window.partitionBy("sequence_id").orderBy(F.desc("b"), "copy")
    packed = placed.where("sequence_id is not null").withColumn("offset", F.coalesce(F.sum("r").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    gap = packed.groupBy("sequence_id").agg(F.sum("r").alias("offset")).where(F.col("offset") < SEQUENCE).withColumn("n", SEQUENCE - F.col("offset"))
    gaps = running(gap, F.col("n"), "at", parts, [], ["sequence_id"])
    fillers = running(placed.where("sequence_id is null").select("row", "start", F.col("r").alias("n")), F.col("n"), "at", parts, [], ["row"])
    gaps, fillers = Staged(gaps, "gaps").df, Staged(fillers, "fillers").df
    have, need = (df.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for df in (fillers, gaps))
    first = max((base + (high - low) // copies for _, low, high, copies, base in slots), default=0)
    more, last = divmod(max(0, have - need), SEQUENCE)
    own = spark.range(more).select((F.col("id") + first).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), (F.col("id") * SEQUENCE + need).alias("at"), F.lit(SEQUENCE).cast("long").alias("n"))
    powers, at_, k = [], need + more * SEQUENCE, first + more
    for bit in (1 << b for b in range(SEQUENCE.bit_length() - 1, -1, -1)):
        if last & bit:
            powers.append((k, 0, at_, bit))
            at_, k = at_ + bit, k + 1
    room = gaps.select("sequence_id", "offset", "at", "n").unionByName(own).unionByName(spark.createDataFrame(powers, "sequence_id long, offset long, at long, n long"))
    whole = running(lengths.where(F.col("n") >= SEQUENCE), F.floor(F.col("n") / SEQUENCE), "ahead", parts, [], ["row"])
    whole = whole.select("row", "ahead", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / SEQUENCE) - 1)).alias("k"))
    whole = whole.select("row", (F.col("k") * SEQUENCE).alias("start"), F.lit(SEQUENCE).cast("long").alias("length"), (F.col("ahead") + F.col("k") + k).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    packed = packed.select("row", "start", F.col("r").alias("length"), "sequence_id", "offset")
    return whole.unionByName(packed).unionByName(aligned(fillers, room))


def pack(df: DataFrame, path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each piece: id, start, length, ids, doc_tokens, sequence_id, offset.

    A document's ids are those of its whole text and a closing ``END_ID``; a null text is an empty one, whose single
    piece is that id. ``ids`` holds a piece's ids as little-endian unsigned 32-bit integers. Each sequence holds at most
    ``SEQUENCE`` ids, gapless from offset 0. Repeated rows are documents of their own; other columns of df are dropped.
    An empty df gives no rows.
    """
    spark = df.sparkSession
    small_batches(spark)
    own = Staged(tokens(df, path, id, text), "tokens", compression="zstd").df
    pieces = pieces_of(spark, own.select("row", "n"))
    by_row = pieces.groupBy("row").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("pieces"))
    both = own.join(by_row, "row").select("id", "n", "ids", "pieces")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = word_ids(path).width
        for batch in batches:
            rows: list[tuple] = []
            for key, n, ids, own in zip(*(batch.column(k).to_pylist() for k in range(4))):
                ids = np.append(np.frombuffer(ids, width).astype("<u4"), np.uint32(END_ID)).astype("<u4")
                rows += [(key, p["start"], p["length"], ids[p["start"] : p["start"] + p["length"]].tobytes(), n, p["sequence_id"], p["offset"]) for p in own]
            for k in range(0, len(rows), 4096):
                columns = list(zip(*rows[k : k + 4096]))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], [id, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    return both.mapInArrow(cut, f"`{id}` long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
