"""Quality rules: base counts, and a hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Everything is DataFrame functions. Word unigrams and bigrams are hashed to a fixed number of buckets; the target's and
the corpus's bucket counts, over all documents, give each bucket the weight log p_target - log p_raw. A document's score
is the mean weight of its n-grams, and the threshold is a fixed low quantile of the trusted documents' own scores, taken
from an exact histogram, so that every document is judged alike and runs agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idweave.llm.common import Staged

BUCKETS = 4096
SMOOTHING = 1.0
QUANTILE = 0.005  #: of the trusted documents that may fall under the threshold
STEP = 1e-3  #: width of the histogram's bins
MARGIN = 0.02
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
BROADCAST_IDS = 1_000_000  #: trusted ids are broadcast up to this count and shuffled beyond it
LEAST_WORDS = 50
MOST_REPEATED = 50  #: per cent of the words


def without(text: Column, characters: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def bind(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_list(text: Column) -> Column:
    return F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """How many words lie in a three-word window that the list holds twice or more."""
    window = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda k: F.xxhash64(words[k], words[k + 1], words[k + 2]))

    def counted(h: Column) -> Column:
        ordered = F.array_sort(F.transform(h, lambda x, k: F.struct(x.alias("h"), k.alias("k"))))

        def covered(s: Column) -> Column:
            last = F.size(s) - 1
            same = lambda k: ((k > 0) & (s[F.greatest(k - 1, F.lit(0))]["h"] == s[k]["h"])) | ((k < last) & (s[F.least(k + 1, last)]["h"] == s[k]["h"]))
            at = F.transform(F.filter(F.sequence(F.lit(0), last), same), lambda k: s[k]["k"])
            return F.size(F.array_distinct(F.flatten(F.transform(at, lambda p: F.array(p, p + 1, p + 2)))))

        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(bind(ordered, covered))

    return F.when(F.size(words) < 4, 0).otherwise(bind(window, counted)).cast("long")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    own = F.filter(F.split(text, "\n"), lambda x: F.length(without(x, SPACE)) > 0)
    return bind(own, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long")


def ngram_buckets(words: Column, buckets: int = BUCKETS) -> Column:
    """Buckets of the words, and of each pair of neighbours."""
    one = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))
    two = F.transform(words, lambda w, k: F.when(k > 0, F.pmod(F.xxhash64(words[F.greatest(k - 1, F.lit(0))], w), F.lit(buckets)).cast("int")))
    return F.concat(one, F.filter(two, lambda b: b.isNotNull()))


def prepared(df: DataFrame, text: str) -> DataFrame:
    """df with base counts and the n-grams' buckets."""
    value = F.coalesce(F.col(text), F.lit(""))
    words = word_list(value)
    facts = bind(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words"), ngram_buckets(w).alias("buckets")))
    plain = F.octet_length(value).cast("long")
    return df.withColumn("facts", facts).select(
        "*",
        F.col("facts.n_words"),
        F.length(without(value, SPACE)).cast("long").alias("word_chars"),
        (plain - F.octet_length(without(value, SYMBOLS))).cast("long").alias("n_symbols"),
        duplicate_lines(value).alias("n_dup_lines"),
        F.col("facts.n_repeat_words"),
    )


def judge(df: DataFrame, trusted: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of df: id, base counts, base_failed, llr and kept.

    The first column of trusted holds the ids of the target's documents (nulls and repeats do not matter). Null texts
    have no words, so base_failed holds. Without trusted rows every weight is 0 and only the base rules decide. Repeated
    rows are counted and judged each; columns of df other than id and text are dropped, whatever their names.
    """
    rows = df.select(F.col(id).alias("id"), F.col(text).alias("text"))
    target_ids = trusted.select(F.col(trusted.columns[0]).alias("id"), F.lit(True).alias("trusted")).where("id is not null").distinct()
    target_ids = Staged(target_ids, "trusted").df
    few = target_ids.count() <= BROADCAST_IDS
    marked = rows.join(F.broadcast(target_ids) if few else target_ids.hint("shuffle_hash"), "id", "left")
    counted = marked.select("trusted", F.explode(bind(word_list(F.coalesce("text", F.lit(""))), lambda w: ngram_buckets(w))).alias("b")).groupBy("b").agg(F.count("*").alias("raw"), F.count("trusted").alias("target"))
    counts = {r["b"]: r for r in counted.collect()}  # BUCKETS rows at most
    raw, target = (sum(r[k] for r in counts.values()) for k in ("raw", "target"))
    share = lambda n, all_n: math.log((n + SMOOTHING) / (all_n + SMOOTHING * BUCKETS))
    weight = [share(counts[b]["target"] if b in counts else 0, target) - share(counts[b]["raw"] if b in counts else 0, raw) if target else 0.0 for b in range(BUCKETS)]
    weights = F.split(F.lit(",".join(f"{w:.9g}" for w in weight)), ",").cast("array<double>")
    total = F.aggregate(F.col("facts.buckets"), F.lit(0.0), lambda a, b: a + weights[b])
    llr = F.when(F.size("facts.buckets") > 0, total / F.size("facts.buckets")).otherwise(F.lit(0.0))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    scored = prepared(rows, "text").withColumn("llr", llr).withColumn("base_failed", failed).drop("facts", "text")
    scored = Staged(scored, "quality").df
    bins = scored.where("not base_failed").join(target_ids, "id", "left_semi").groupBy(F.floor(F.col("llr") / STEP).alias("bin")).agg(F.count("*").alias("n")).orderBy("bin").collect()
    need, least = QUANTILE * sum(r["n"] for r in bins), -math.inf
    for r in bins:
        need -= r["n"]
        if need <= 0:
            least = r["bin"] * STEP - MARGIN
            break
    return scored.select(F.col("id").alias(id), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", (~F.col("base_failed") & (F.col("llr") >= F.lit(least))).alias("kept"))
