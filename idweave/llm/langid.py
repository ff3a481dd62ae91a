"""Language identification with interpolated Kneser-Ney character models.

Training counts the character n-grams of a bounded, labelled sample on Spark; smoothing works on those bounded counts.
All languages share one table an order: the n-grams' 64-bit hashes, sorted, beside each language's fully interpolated
log probability, so one binary search serves every language. A text goes to the language of least cross-entropy a
character; where even that is above what the language's own calibration texts have, the prediction is marked rejected.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from idweave.llm.common import class_sample, map_text

ORDER = 4
TRAIN_TEXTS = 400  #: different texts of each language that the counts come from, whole
CALIBRATE_TEXTS = 200  #: further ones, for the rejection thresholds
REJECT_QUANTILE = 0.999
BLOCK = 1 << 19
UNDETERMINED = "und"
PRIME = np.uint64(0x9E3779B97F4A7C15)


@cache
def letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def characters(text: str) -> np.ndarray:
    """Lower-case letters, every run of anything else as one space, with spaces at both ends; empty without letters."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[points]
    if not is_letter.any():
        return np.empty(0, np.uint32)
    points = np.concatenate([[32], np.where(is_letter, points, 32), [32]]).astype(np.uint32)
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != 32) | (points[:-1] != 32)
    return points[keep]


def hashes(points: np.ndarray, n: int) -> np.ndarray:
    """Of each n-gram, in order."""
    wide = points.astype(np.uint64) + np.uint64(1)
    h = np.zeros(max(0, len(points) - n + 1), np.uint64)
    for k in range(n):
        h += wide[k : len(points) - n + 1 + k]
        h *= PRIME
        h ^= h >> np.uint64(29)
    return h


def find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


@dataclass
class KneserNey:
    languages: list[str]
    grams: list[np.ndarray]  # by order: sorted hashes
    log_p: list[np.ndarray]  # by order: gram x language
    contexts: list[np.ndarray]  # by order: sorted hashes of contexts one character shorter
    log_back: list[np.ndarray]  # by order: context x language
    log_unseen: float
    limit: np.ndarray | None = None

    def cross_entropy(self, points: np.ndarray) -> np.ndarray:
        """Nats a character for each language; the first characters have shorter contexts."""
        order, total = len(self.grams), np.zeros(len(self.languages))
        for start in range(0, len(points), BLOCK):
            block = points[max(0, start - order + 1) : start + BLOCK]
            lead = min(start, order - 1)  # context from the block before
            total += self._sum(block, lead)
        return -total / max(1, len(points))

    def _sum(self, points: np.ndarray, lead: int) -> np.ndarray:
        order, m = len(self.grams), len(points)
        total, todo = np.zeros(len(self.languages)), np.arange(lead, m)
        for n in range(order, 0, -1):
            own = todo[todo >= n - 1]
            if len(own) == 0:
                continue
            h = hashes(points, n)
            at, hit = find(self.grams[n - 1], h[own - (n - 1)])
            total += np.bincount(at[hit], minlength=len(self.grams[n - 1])) @ self.log_p[n - 1]
            missed = own[~hit]
            if n > 1 and len(missed):
                at, known = find(self.contexts[n - 1], hashes(points, n - 1)[missed - (n - 1)])
                total += self.log_back[n - 1][at[known]].sum(0)
            elif n == 1:
                total += len(missed) * self.log_unseen
            todo = np.concatenate([todo[todo < n - 1], missed])
        return total


def kneser_ney(languages: list[str], lang: np.ndarray, grams: np.ndarray, counts: np.ndarray) -> KneserNey:
    """Of the highest order's counts: language number, n-gram as code points, times seen, a row each."""
    n_lang, order = len(languages), grams.shape[1]
    level: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(lang, grams, counts.astype(float))]
    for _ in range(order - 1):  # below the top, an n-gram counts once for each character seen before it
        lang, grams, _ = level[0]
        rows, times = np.unique(np.column_stack([lang, grams[:, 1:]]), axis=0, return_counts=True)
        level.insert(0, (rows[:, 0], rows[:, 1:], times.astype(float)))
    alphabet = len(np.unique(level[0][1])) + 1
    model = KneserNey(languages, [], [], [], [], float(-np.log(alphabet)))
    for n, (lang, grams, c) in enumerate(level, 1):
        discount = np.array([(lambda one, two: one / (one + 2 * two) if one else 0.5)((c[lang == k] == 1).sum(), (c[lang == k] == 2).sum()) for k in range(n_lang)])
        keys, first, at = np.unique(_row_hashes(grams), return_index=True, return_inverse=True)
        seen = np.zeros((len(keys), n_lang))
        seen[at, lang] = c
        context, ctx_at = np.unique(_row_hashes(grams[first][:, :-1]), return_inverse=True) if n > 1 else (np.zeros(1, np.uint64), np.zeros(len(keys), int))
        total, kinds = np.zeros((len(context), n_lang)), np.zeros((len(context), n_lang))
        np.add.at(total, ctx_at, seen)
        np.add.at(kinds, ctx_at, seen > 0)
        back = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
        if n == 1:
            lower = np.full((len(keys), n_lang), 1 / alphabet)
        else:
            suffix, _ = find(model.grams[-1], _row_hashes(grams[first][:, 1:]))
            lower = np.exp(model.log_p[-1][suffix])
        p = np.maximum(seen - discount, 0) / np.maximum(total, 1)[ctx_at] + back[ctx_at] * lower
        model.grams.append(keys)
        model.log_p.append(np.log(np.maximum(p, 1e-12)))
        model.contexts.append(context)
        model.log_back.append(np.log(np.maximum(back, 1e-12)))
    return model


def _row_hashes(grams: np.ndarray) -> np.ndarray:
    h = np.zeros(len(grams), np.uint64)
    for k in range(grams.shape[1]):
        h += grams[:, k].astype(np.uint64) + np.uint64(1)
        h *= PRIME
        h ^= h >> np.uint64(29)
    return h


def train(df: DataFrame, text: str = "text", lang: str = "lang", order: int = ORDER, train_texts: int = TRAIN_TEXTS, calibrate_texts: int = CALIBRATE_TEXTS) -> KneserNey | None:
    """Fit on at most train_texts + calibrate_texts different texts of each language; None without any labelled letter.

    The bound is on rows of the sample; its texts are used whole, and what comes to the driver is their distinct n-grams.
    """
    sample = class_sample(df, lang, text, train_texts + calibrate_texts)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                s = "".join(map(chr, characters(value)))
                seen.update((name, s[k : k + order]) for k in range(len(s) - order + 1))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["cls", "gram", "n"])

    # The training part alternates with the calibration part along the hash order, so that a small class has both.
    part = F.pmod("k", F.lit(train_texts + calibrate_texts) / F.lit(max(1, calibrate_texts))) < 1 if calibrate_texts else F.lit(False)
    counted = sample.where(~part).select(F.col("cls").cast("string"), "text").mapInArrow(count, "cls string, gram string, n long").groupBy("cls", "gram").agg(F.sum("n").alias("n")).toPandas()
    if not len(counted):
        return None
    counted = counted.sort_values(["cls", "gram"])
    languages = sorted(counted["cls"].unique())
    number = counted["cls"].map({k: i for i, k in enumerate(languages)}).to_numpy()
    points = np.frombuffer("".join(counted["gram"]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, order)
    model = kneser_ney(languages, number, points, counted["n"].to_numpy())
    model.limit = np.full(len(languages), np.inf)
    held = predict(sample.where(part).select(F.col("cls").cast("string"), "text"), model).where("lang_pred = cls").groupBy("cls").agg(F.percentile("cross_entropy", REJECT_QUANTILE).alias("q"))
    for row in held.collect():
        model.limit[languages.index(row["cls"])] = row["q"] * 1.1
    return model


def predict(df: DataFrame, model: KneserNey | None, text: str = "text", rejected_as: str | None = None) -> DataFrame:
    """df with lang_pred, score (0 to 1), cross_entropy and rejected; columns of those names are replaced.

    Null texts and texts without a letter, or all texts where nothing was learned, have lang_pred ``und``, score 0 and
    null cross_entropy. Ties go to the language first in order. ``rejected_as`` names rejected texts' lang_pred.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    extra = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("cross_entropy", T.DoubleType()), T.StructField("rejected", T.BooleanType())])

    def make(texts: list[str | None]) -> tuple[list, ...]:
        model, out = shared.value, []
        for value in texts:
            points = characters(value) if value and model else ()
            if not len(points):
                out.append((UNDETERMINED, 0.0, None, False))
                continue
            h = model.cross_entropy(points)
            best = int(np.argmin(h))
            weight = np.exp(-(h - h[best]) * min(len(points), 40))
            rejected = bool(model.limit is not None and h[best] > model.limit[best])
            out.append((rejected_as if rejected and rejected_as else model.languages[best], float(1 / weight.sum()), float(h[best]), rejected))
        return tuple(map(list, zip(*out))) if out else ([], [], [], [])

    return map_text(df, text, extra, make)
