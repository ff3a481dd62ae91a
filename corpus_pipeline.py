"""Corpus pipeline: toxicity, line de-duplication, near documents, repeated passages, packing.

A stage writes what it decides (lines or ids that go; of passages the anchors that documents share) and drops what its result
does not read. So a result can be read at any time, however stages are chained, and none touches another's tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from idweave.llm import line_dedup, ngram_join, packing, repeats, toxicity
from idweave.llm.common import Staged, decided, small_batches, table

ORACLE_SQL = None
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score, learned from the labelled ones among docs, stays under a half.

    Null and empty texts have a score as well; without labelled documents every score is 0 and all stay.
    """
    small_batches(spark)
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").join(docs.select("doc_id"), "doc_id", "left_semi")
    own = Staged(labels, "labels")
    chosen = toxicity.sample_ids(own.df)  # 4,000 ids at most
    model = toxicity.train(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), counts=toxicity.class_counts(own.df))
    own.drop()
    score = f"score_{uuid.uuid4().hex}"
    return toxicity.score(docs, model, out=score).where(f"{score} < 0.5").select(*docs.columns)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that equal or nearly equal an earlier one; null texts and rows with a null id stay as they are."""
    return line_dedup.drop_lines(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of least doc_id; texts without words and rows with a null id stay."""
    gone = decided(lambda: ngram_join.near_documents(docs).where("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("kept")).where("not kept").select("doc_id"), "gone")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)  # those that go are fewer than those that stay


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without byte strings that a smaller document holds; what a cut leaves of a character goes too.

    Null texts and rows with a null id stay as they are.
    """
    valid = F.make_valid_utf8(F.col("kept").cast("string"))
    text = F.when(F.size("spans") == 0, F.col("text")).when(F.contains("text", F.lit("�")), valid).otherwise(F.replace(valid, F.lit("�"), F.lit("")))
    done = repeats.without_repeats(docs).withColumn("text", text)
    return done.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids in sequences, as pieces; a null text is empty and has its one closing id."""
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_lines),
    ("ngram_jaccard_join", one_of_each_group),
    ("suffix_dedup", without_repeated_passages),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each leaves is written and read again before the next, which then replaces it."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        kept = Staged(stage(spark, docs, sf_dir), name)
        if before:
            before.drop()
        docs, before = kept.df, kept
    return STAGES[-1][1](spark, docs, sf_dir)
