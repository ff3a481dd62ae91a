"""Benchmark decontamination: an FM-index for every shard of documents, searched for the windows of all items.

A shard's alphabet is those of its words that occur in an item: no match holds any other word, so those are left out and
end a segment, as do runs too short for the shortest window. Which words occur is told by a bitmap of fixed size, whose
false hits only make the index larger. Windows are found by backward search, their places by sampled suffix positions,
and overlapping ones merge into spans.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from idweave.llm.common import small_batches, staged
from idweave.llm.fm_index import FmIndex
from idweave.llm.terms import word_column, words

WINDOW = 10
MAP_BITS = 24
SEGMENT = 256
SHARD_SYMBOLS, SHARD_DOCUMENTS, SHARD_WORDS = 1 << 20, 1 << 16, 1 << 23
MOST_WORDS = 500_000  #: of the items that one pass over the indexes looks for, told to every task
REMEMBERED = 500_000
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
SHARD = "shard string, ids binary, known binary, n_words binary, vocabulary binary, segments binary, index binary"


def word_map(items: DataFrame) -> np.ndarray:
    """2 ** MAP_BITS bits: those that words of ``items`` (words) fall on."""
    slot = items.select(F.explode("words").alias("w")).select((F.crc32("w") % (1 << MAP_BITS)).alias("s"))
    rows = slot.select((F.col("s") / 64).cast("int").alias("at"), F.expr("shiftleft(1L, cast(s % 64 as int))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits"))
    out = np.zeros(1 << (MAP_BITS - 6), np.int64)
    for r in rows.collect():  # as many as the map has words at most
        out[r["at"]] = r["bits"]
    return out.view(np.uint64)


class Symbols(dict):
    """Numbers from 1 of words on the map, 0 for all others; what is remembered of the others is bounded."""

    def __init__(self, bits: np.ndarray):
        super().__init__()
        self.bits = bits
        self.number: dict[bytes, int] = {}

    def __missing__(self, word: bytes) -> int:
        known = self.number.get(word)
        if known is None:
            slot = zlib.crc32(word) & ((1 << MAP_BITS) - 1)
            known = 0
            if (int(self.bits[slot >> 6]) >> (slot & 63)) & 1:
                known = self.number[word] = len(self.number) + 1
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = known
        return known


def segments(symbols: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last place (exclusive) of segments that cover all runs of at least ``shortest`` words on the map.

    Long runs are cut into segments that overlap by a window less one word.
    """
    edge = np.flatnonzero(np.diff(np.concatenate([[False], symbols > 0, [False]]).astype(np.int8)))
    a, b = edge[::2], edge[1::2]
    long = b - a >= shortest
    a, b = a[long], b[long]
    step = SEGMENT - WINDOW + 1
    pieces = np.maximum(1, -(-(b - a - WINDOW + 1) // step))
    begin = np.repeat(a, pieces) + step * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    return begin, np.minimum(begin + SEGMENT, np.repeat(b, pieces))


def indexed(id: str, text: str, told: Broadcast, shortest: int):
    """A row for each shard of a task's documents: its documents' ids and lengths, vocabulary, segments and FM-index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Symbols(told.value)
        ids, lengths, held = [], [], []
        size = read = 0

        def shard() -> pa.RecordBatch:
            parts = [np.concatenate([p[k] for p in held]) if held else np.empty(0, np.int64) for k in range(4)]
            there, text = np.unique(parts[3], return_inverse=True)
            zero = int(len(there) > 0 and there[0] == 0)  # every segment ends in a 0
            index = FmIndex.of(text.astype(np.int32), len(there)).saved() if zero else b""
            names = [b""] * (len(known.number) + 1)
            for w, k in known.number.items():
                names[k] = w
            vocabulary = b" ".join(names[k] for k in there[zero:].tolist())
            row = [uuid.uuid4().hex, np.array([i or 0 for i in ids], np.int64), np.array([i is not None for i in ids], bool), np.array(lengths, np.int64), vocabulary, np.concatenate(parts[:3]).astype(np.int64), index]
            return pa.RecordBatch.from_arrays([pa.array([x.tobytes() if isinstance(x, np.ndarray) else x]) for x in row], [c.split()[0] for c in SHARD.split(", ")])

        for batch in batches:
            for own, value in zip(batch[id].to_pylist(), batch[text].to_pylist()):
                made = [np.fromiter(map(known.__getitem__, piece), np.int32, len(piece)) for piece in words(value)]
                numbers = np.concatenate(made) if made else np.empty(0, np.int32)
                a, b = segments(numbers, shortest)
                if len(a):
                    n = b - a + 1
                    at = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    ends = np.cumsum(n) - 1
                    letters = numbers[np.minimum(at, len(numbers) - 1)]
                    letters[ends] = 0
                    held.append((np.full(len(a), len(ids)), a, n, letters))
                    size += len(letters)
                ids.append(own)
                lengths.append(len(numbers))
                read += len(numbers)
                if size >= SHARD_SYMBOLS or len(ids) >= SHARD_DOCUMENTS or read >= SHARD_WORDS:
                    yield shard()
                    ids, lengths, held = [], [], []
                    size = read = 0
        if ids:
            yield shard()

    return run


class Windows:
    """The different windows of a block of items, as numbers of a vocabulary, and the items that have each."""

    def __init__(self, rows: list[tuple]):
        self.names = [r[0] for r in rows]
        encoded = [[w.encode("utf-8", "surrogatepass") for w in r[1]] for r in rows]
        self.number = {w: k for k, w in enumerate(dict.fromkeys(chain.from_iterable(encoded)))}
        windows: dict[tuple[int, ...], list[int]] = {}
        for k, own in enumerate(encoded):
            numbers = [self.number[w] for w in own]
            n = min(WINDOW, len(numbers))
            for i in range(len(numbers) - n + 1):
                having = windows.setdefault(tuple(numbers[i : i + n]), [])
                if not having or having[-1] != k:
                    having.append(k)
        self.length = np.array([len(w) for w in windows], np.int64)
        self.windows = np.array([(0,) * (WINDOW - len(w)) + w for w in windows], np.int64).reshape(-1, WINDOW)
        self.first = np.cumsum([0, *map(len, windows.values())])
        self.items = np.array(list(chain.from_iterable(windows.values())), np.int64)


def merged(group: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Groups' intervals in order, overlapping and touching ones as one."""
    order = np.lexsort((a, group))
    group, a, b = group[order], a[order], b[order]
    if not len(a):
        return group, a, b
    wide = int(b.max()) + 2
    reach = np.maximum.accumulate(b + group * wide)
    new = np.concatenate([[True], a[1:] + group[1:] * wide > reach[:-1]])
    return group[new], a[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(a) - 1)] - group[new] * wide


def ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


def lists(group: np.ndarray, groups: int, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(group, np.arange(groups + 1)), pa.int32()), values)


def searched(told: Broadcast, kind: pa.DataType):
    """shard, place, id, n_words, spans and items of every document of the indexes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = told.value
        for batch in batches:
            for row in batch.to_pylist():
                ids, n_words, part = (np.frombuffer(row[c], np.int64) for c in ("ids", "n_words", "segments"))
                doc, word, n = part.reshape(3, -1)
                local = np.zeros(len(block.number), np.int64)
                for k, w in enumerate(row["vocabulary"].split(b" ")):
                    if w in block.number:
                        local[block.number[w]] = k + 1
                phrases = local[block.windows] if len(block.number) else block.windows
                full = ((phrases > 0) | (np.arange(WINDOW) < WINDOW - block.length[:, None])).all(1)
                which = np.flatnonzero(full) if row["index"] else np.empty(0, np.int64)
                own, a, b, of = (np.empty(0, np.int64),) * 4
                if len(which):
                    index = FmIndex.loaded(row["index"])
                    low, high = index.search(phrases[which], block.length[which])
                    of = np.repeat(which, high - low)
                    at = index.located(ranges(low, high - low))
                    first = np.cumsum(n) - n
                    segment = np.searchsorted(first, at, "right") - 1
                    own, a = doc[segment], word[segment] + at - first[segment]
                    b = a + block.length[of]
                group, a, b = merged(own, a, b)
                pair = np.unique(own * max(1, len(block.length)) + of)
                d, w = np.divmod(pair, max(1, len(block.length)))
                times = np.diff(block.first)[w]
                pair = np.unique(np.repeat(d, times) * max(1, len(block.names)) + block.items[ranges(block.first[w], times)])
                d, i = np.divmod(pair, max(1, len(block.names)))
                span = pa.StructArray.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["start", "end"])
                made = [
                    pa.array([row["shard"]] * len(ids)),
                    pa.array(np.arange(len(ids)), pa.int64()),
                    pa.array(ids, pa.int64(), mask=~np.frombuffer(row["known"], bool)),
                    pa.array(n_words, pa.int64()),
                    lists(group, len(ids), span),
                    lists(d, len(ids), pa.array([block.names[k] for k in i.tolist()], kind)),
                ]
                yield pa.RecordBatch.from_arrays(made, ["shard", "place", "id", "n_words", "spans", "items"])

    return run


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose spans, gathered from several passes, are in order and merged."""
    for batch in batches:
        rows = batch["spans"].to_pylist()
        group = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        flat = [s for r in rows for s in r]
        group, a, b = merged(group, *(np.array([s[c] for s in flat], np.int64) for c in ("start", "end")))
        span = pa.StructArray.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["start", "end"])
        yield pa.RecordBatch.from_arrays([lists(group, len(rows), span) if c == "spans" else batch[c] for c in batch.schema.names], batch.schema.names)


def contaminated(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", most_words: int = MOST_WORDS) -> DataFrame:
    """id, n_words, spans and items of every row of docs.

    A window is ``WINDOW`` consecutive words of an item, or a shorter item whole. spans are the word places (start, end
    exclusive) that lie in an occurrence of any window, overlapping and touching ones merged; items are the ids of the items
    that have an occurring window, each once.

    Null and empty texts have no words, and items without words no window. Repeated rows are documents of their own; a null
    id stays null. Items with one id and several texts have the windows of each; those of a null id mark words but are not
    listed. Other columns are not read. Items of more than ``most_words`` words are sought in several passes over the
    staged indexes, each with a part of the items.
    """
    spark = docs.sparkSession
    small_batches(spark)
    own = items.select(F.col(item).alias("item"), word_column(F.col(item_text).cast("string")).alias("words"), F.xxhash64(item, item_text).alias("h")).where(F.size("words") > 0).distinct()
    total, shortest = own.agg(F.sum(F.size("words")), F.min(F.least(F.size("words"), F.lit(WINDOW)))).first()
    total, shortest = total or 0, shortest or WINDOW
    passes = 1 if total <= most_words else 2 * -(-total // most_words)
    bits = spark.sparkContext.broadcast(word_map(own))
    index = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(indexed("id", "text", bits, shortest), SHARD)
    index = index if passes == 1 else staged(index, "indexes")
    kind = own.schema["item"]
    field, name = to_arrow_schema(own.select("item").schema).field(0), kind.dataType.simpleString()
    schema = f"shard string, place long, id long, n_words long, spans array<struct<start: long, end: long>>, items array<{name}>"
    found = None
    for at in range(passes):
        block = spark.sparkContext.broadcast(Windows(own.where(F.pmod("h", F.lit(passes)) == at).select("item", "words").collect()))  # bounded by most_words
        one = index.mapInArrow(searched(block, field.type), schema)
        found = one if found is None else found.unionByName(one)
    if passes > 1:
        every = found.groupBy("shard", "place").agg(F.first("id").alias("id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
        found = every.mapInArrow(joined, every.schema)
    return found.select(F.col("id").alias(id), "n_words", "spans", F.array_distinct(F.array_compact("items")).alias("items"))


def without_spans(docs: DataFrame, found: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs whose texts have lost the spans of ``found``, from the first byte of a span's first word to the last of its last.

    Other columns stay. Null texts and rows with a null id stay as they are; an id names one text.
    """
    gone = f"spans_{uuid.uuid4().hex}"
    spans = found.where((F.size("spans") > 0) & F.col(id).isNotNull()).select(id, F.col("spans").alias(gone)).dropDuplicates([id])
    both = docs.join(spans, id, "left").select(*docs.columns, gone)
    names, at, spans_at = docs.columns, docs.columns.index(text), len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value, own in zip(batch.column(at).to_pylist(), batch.column(spans_at).to_pylist()):
                if value and own:
                    data = value.encode("utf-8", "surrogatepass")
                    place = [m.span() for m in WORD.finditer(data)]
                    edge = [0, *[x for s in own for x in (place[s["start"]][0], place[s["end"] - 1][1])], len(data)]
                    value = b"".join(data[i:j] for i, j in zip(edge[::2], edge[1::2])).decode("utf-8", "surrogatepass")
                out.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if k == at else c for k, c in enumerate(batch.columns[:spans_at])], names)

    return both.mapInArrow(run, docs.schema)
