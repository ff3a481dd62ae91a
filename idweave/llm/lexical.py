"""Ranked lexical search, score at a time: postings in order of their exact impact, the highest first.

The documents are cut into shards of bounded size. A shard lists, for each term, its postings by falling impact; an item's
groups of equal impact are added up from the highest down, term by term, until what the terms can still add proves that no
other document reaches the best k. The few documents that still can are then scored in full. Every task keeps the best k
of its shards, and the best of the tasks' are ranked.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from idweave.llm.common import Staged, small_batches
from idweave.llm.terms import word_column, words

MOST_PAIRS = 1_000_000  #: of an item and a term that one pass over the documents looks for, told to every task
SHARD_POSTINGS = 2_000_000
FEW = 256  #: documents that are scored in full rather than narrowed down further


class Items:
    """A block of items: their terms as places in a sorted vocabulary, with repeats; weights are set once df is known."""

    def __init__(self, rows: list[tuple]):
        self.names = [r[0] for r in rows]
        self.vocabulary = sorted({t.encode("utf-8", "surrogatepass") for r in rows for t in r[1]})
        place = {t: k for k, t in enumerate(self.vocabulary)}
        counts = [Counter(place[t.encode("utf-8", "surrogatepass")] for t in r[1]) for r in rows]
        self.terms = [np.fromiter(c.keys(), np.int64, len(c)) for c in counts]
        self.repeats = [np.fromiter(c.values(), np.int64, len(c)) for c in counts]
        self.weight = np.zeros(len(self.vocabulary), np.int64)


class Shard:
    """Postings of some documents: by document, and by term in order of falling impact (before the term's weight)."""

    def __init__(self, ids: np.ndarray, known: np.ndarray, size: np.ndarray, terms: np.ndarray, times: np.ndarray, m: np.ndarray):
        self.ids, self.known = ids, known
        self.first = np.concatenate([[0], np.cumsum(size)])
        self.terms = terms
        doc = np.repeat(np.arange(len(ids)), size)
        self.impact = (1_000_000_000 * times) // (1000 * times + 12 * m[doc])
        order = np.lexsort((-self.impact, terms))
        self.docs, self.falling = doc[order], self.impact[order]
        self.rising = -self.falling
        there, at = np.unique(terms[order], return_index=True)
        self.begin = dict(zip(there.tolist(), zip(at.tolist(), np.append(at[1:], len(order)).tolist())))

    def whole(self, docs: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Full scores of docs for terms of the given values."""
        a, b = self.first[docs], self.first[docs + 1]
        n = b - a
        rows = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        sums = np.concatenate([[0], np.cumsum(value[self.terms[rows]] * self.impact[rows])])
        ends = np.cumsum(n)
        return sums[ends] - sums[ends - n]

    def best(self, terms: np.ndarray, value: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents of this shard among which are its k best of ``floor`` or more, with full scores."""
        own = [(self.begin[t], v) for t, v in zip(terms.tolist(), value[terms].tolist()) if v > 0 and t in self.begin]
        acc = np.zeros(len(self.ids), np.int64)
        at, end, weight = [a for (a, _), _ in own], [b for (_, b), _ in own], [v for _, v in own]
        while True:
            heads = [w * int(self.falling[i]) if i < j else 0 for i, j, w in zip(at, end, weight)]
            bound = sum(heads)
            kth = int(np.partition(acc, -k)[-k]) if len(acc) >= k else 0
            least = max(kth, floor, 1)
            if bound < least:
                found = np.flatnonzero(acc + bound >= least)
                if bound == 0:
                    return found, acc[found]
                if len(found) <= max(FEW, 2 * k):
                    return found, self.whole(found, value)
            level = max(heads) // 2 + 1
            for x, (i, j, w) in enumerate(zip(at, end, weight)):
                if heads[x] >= level:
                    to = i + int(np.searchsorted(self.rising[i:j], -(-(-level // w)), "right"))
                    np.add.at(acc, self.docs[i:to], w * self.falling[i:to])
                    at[x] = to


def counted(id: str, text: str, items: Broadcast):
    """Of every document its id, number of terms, and those of the items' terms that it holds, with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {t: k for k, t in enumerate(items.value.vocabulary)}
        for batch in batches:
            size, terms, times = [], [], []
            for value in batch[text].to_pylist():
                n, own = 0, Counter()
                for piece in words(value):
                    n += len(piece)
                    own.update(filter(place.__contains__, piece))
                size.append(n)
                terms.append([place[t] for t in own])
                times.append(list(own.values()))
            yield pa.RecordBatch.from_arrays([batch[id], pa.array(size, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int32()))], ["id", "n", "terms", "times"])

    return run


def searched(items: Broadcast, k: int, documents: int, total: int, most: int):
    """item_no, id and score of the k best documents of a task for every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = items.value
        value = np.zeros(len(own.vocabulary), np.int64)
        top: list[tuple[np.ndarray, np.ndarray, np.ndarray] | None] = [None] * len(own.names)

        def shard(held: list[pa.RecordBatch]) -> None:
            rows = pa.Table.from_batches(held)
            ids = rows["id"].combine_chunks()
            lists, times = rows["terms"].combine_chunks(), rows["times"].combine_chunks()
            m = np.array([75 + 25 * n * documents // total for n in rows["n"].to_pylist()], np.int64)
            flat = lambda a: a.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            index = Shard(ids.fill_null(0).to_numpy(zero_copy_only=False), np.array(ids.is_valid()), lists.value_lengths().to_numpy(), flat(lists), flat(times), m)
            for i, (terms, repeats) in enumerate(zip(own.terms, own.repeats)):
                value[terms] = own.weight[terms] * repeats
                before = top[i]
                docs, score = index.best(terms, value, k, int(before[2][-1]) if before and len(before[2]) == k else 0)
                value[terms] = 0
                if len(docs):
                    new = (index.ids[docs], index.known[docs], score)
                    both = tuple(map(np.concatenate, zip(before, new))) if before else new
                    order = np.lexsort((both[0], ~both[1], -both[2]))[:k]
                    top[i] = tuple(x[order] for x in both)

        held, size = [], 0
        for batch in batches:
            batch = batch.filter(pa.compute.greater(batch["n"], 0))
            held.append(batch)
            size += len(batch["terms"].flatten()) + batch.num_rows
            if size >= most:
                shard(held)
                held, size = [], 0
        if size:
            shard(held)
        for i, best in enumerate(top):
            if best:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best[0]), i, np.int32)), pa.array(best[0], pa.int64(), mask=~best[1]), pa.array(best[2], pa.int64())], ["item_no", "id", "score"])

    return run


def named(items: Broadcast, kind: pa.DataType, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = items.value.names
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([own[k] for k in batch["item_no"].to_pylist()], kind), batch["rank"], batch["id"], batch["score"]], names)

    return run


def search(docs: DataFrame, items: DataFrame, k: int = 20, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", most_pairs: int = MOST_PAIRS, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """item, rank, id, score: each item's k highest-scoring documents with a score above 0, equal scores by ascending id.

    A term's weight w is floor(1000 ln((2N + 2) / (2df + 1))); a document of n terms has m = 75 + 25 n N div L and its
    score is the sum of w ((1000000000 tf) div (1000 tf + 12 m)) over the item's terms, repeats included.

    Every row of docs is a document of its own, repeated rows too; null ids come last among equals. Null texts have no
    terms and are neither counted nor found. Rows of items with equal id and text are one item; rows with equal ids and other
    texts are ranked each for itself. Other columns are not read. Items of more than ``most_pairs`` pairs of an item and a
    term are looked for in several passes, each with a part of the items; a task holds ``shard_postings`` postings and the
    terms of one batch of documents at a time.
    """
    spark = docs.sparkSession
    small_batches(spark)
    wanted = items.select(F.col(item).alias("item"), F.col(item_text).cast("string").alias("text")).where("text is not null").distinct()
    wanted = wanted.select("item", word_column(F.col("text")).alias("words"), F.xxhash64("text").alias("h"))
    pairs = wanted.agg(F.sum(F.size(F.array_distinct("words")))).first()[0] or 0
    passes = 1 if pairs <= most_pairs else 2 * -(-pairs // most_pairs)
    own = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    kind = wanted.schema["item"]
    found = None
    for at in range(passes):
        block = Items(wanted.where(F.pmod("h", F.lit(passes)) == at).select("item", "words").collect())  # bounded by most_pairs
        told = spark.sparkContext.broadcast(block)
        rows = Staged(own.mapInArrow(counted("id", "text", told), "id long, n long, terms array<int>, times array<int>"), "postings").df
        documents, total = rows.where("n > 0").agg(F.count("*"), F.sum("n")).first()
        for r in rows.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect():  # one a term of the block
            block.weight[r["t"]] = math.floor(1000 * math.log((2 * documents + 2) / (2 * r["df"] + 1)))
        told = spark.sparkContext.broadcast(block)
        each = rows.mapInArrow(searched(told, k, documents, total or 1, shard_postings), "item_no int, id long, score long")
        order = Window.partitionBy("item_no").orderBy(F.desc("score"), F.asc_nulls_last("id"))
        ranked = each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        field = to_arrow_schema(wanted.select("item").schema).field(0)
        ranked = ranked.mapInArrow(named(told, field.type, [item, "rank", id, "score"]), f"`{item}` {kind.dataType.simpleString()}, rank int, `{id}` long, score long")
        found = ranked if found is None else found.unionByName(ranked)
    return found
