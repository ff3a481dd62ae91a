"""Toxicity by compression distance.

Two zstandard dictionaries are trained on a bounded labelled sample: one on ordinary text, one on toxic text of which
only words are left that begin in a way that ordinary documents hold much less often. A window of a text is compressed
with the ordinary dictionary alone and with the toxic one behind it; the bytes saved are its gain. A logistic model over
a document's gains, calibrated on sample documents that trained no dictionary, makes the score. Dictionaries trained on
whole toxic texts were tried and found less: the README has figures.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from idweave.llm.common import class_sample, map_text

SAMPLE_TEXTS = 2000  #: different labelled texts of each class at most, used whole
DICTIONARY_SHARE = 0.65  #: of the sample that trains dictionaries; the rest calibrates
ORDINARY_BYTES, TOXIC_BYTES = 112_640, 2_048
WINDOW_WORDS = 12
LEAST_RATIO = 20  #: times as many toxic documents as ordinary ones must hold a word or beginning for the toxic dictionary
LEAST_SHARE = 0.02  #: of the toxic documents must hold it
BEGINNINGS = range(4, 9)  #: letters
GAIN = 3  #: bytes saved that count as a hit
WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[bytes]:
    return [w.encode("utf-8", "replace") for w in WORD.findall(text.lower())] if text else []


def windows(own: list[bytes]) -> list[bytes]:
    return [b" " + b" ".join(own[k : k + WINDOW_WORDS]) + b" " for k in range(0, len(own), WINDOW_WORDS)] or [b"  "]


@lru_cache(maxsize=8)
def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    raw = zstandard.DICT_TYPE_FULLDICT if dictionary[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    data = zstandard.ZstdCompressionDict(dictionary, dict_type=raw)
    parameters = zstandard.ZstdCompressionParameters.from_level(1, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False, min_match=3, strategy=zstandard.STRATEGY_BTOPT, window_log=18, hash_log=17, chain_log=17, search_log=6)
    data.precompute_compress(compression_params=parameters)
    return zstandard.ZstdCompressor(dict_data=data, compression_params=parameters)


def lengths(dictionary: bytes, pieces: list[bytes]) -> np.ndarray:
    one = compressor(dictionary)
    return np.fromiter((len(one.compress(p)) for p in pieces), int, len(pieces)) if len(pieces) < 4 else np.fromiter(map(len, one.multi_compress_to_buffer(pieces, threads=1)), int, len(pieces))


@dataclass
class ToxicityModel:
    ordinary: bytes
    toxic: bytes
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None
    constant: float = 0.0

    def features(self, text: str | None) -> list[float]:
        pieces = windows(words(text))
        gain = np.concatenate([lengths(self.ordinary, pieces[k : k + 4096]) - lengths(self.toxic, pieces[k : k + 4096]) for k in range(0, len(pieces), 4096)])
        top, hits = np.sort(gain)[::-1][:3], int((gain >= GAIN).sum())
        return [float(top[0]), float(top[:2].mean()), float(top.mean()), float(gain.mean()), float(np.log1p(hits)), hits / len(gain), float(np.log1p(len(gain)))]

    def score(self, features: list[float]) -> float:
        if self.weights is None:
            return self.constant
        z = np.clip(self.constant + ((np.array(features) - self.mean) / self.scale) @ self.weights, -30, 30)
        return float(1 / (1 + np.exp(-z)))


def dictionary(samples: list[bytes], size: int, segment: int) -> bytes:
    """Trained by zstandard; what is too small for that is used as it is."""
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=6).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:] or b" " * 8


def beginnings(word: bytes) -> list[bytes]:
    """The word, and what it begins with where that is shorter."""
    letters = word.decode("utf-8", "replace")
    return [word, *(letters[:k].encode() for k in BEGINNINGS if k < len(letters))]


def fit_dictionaries(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> ToxicityModel:
    held_t, held_o = (Counter(b for ws in docs for b in {b for w in set(ws) for b in beginnings(w)}) for docs in (toxic, ordinary))
    n_t, n_o = max(1, len(toxic)), max(1, len(ordinary))
    least = max(2, LEAST_SHARE * n_t)
    marked = {w for w, n in held_t.items() if n >= least and n / n_t > LEAST_RATIO * (held_o[w] + 0.3) / n_o}
    dealt = lambda ws, salt: b" " + b" ".join(sorted(ws, key=lambda w: (zlib.crc32(w + salt), w))) + b" "
    plain = dictionary([dealt(set(ws), b"") for ws in ordinary if ws], ORDINARY_BYTES, 24)
    own = dictionary([dealt(found, bytes([k % 7])) for k, ws in enumerate(toxic) if (found := {w for w in ws if not marked.isdisjoint(beginnings(w))})], TOXIC_BYTES, 12)
    return ToxicityModel(plain, plain + own)


def fit_logistic(model: ToxicityModel, x: np.ndarray, y: np.ndarray) -> None:
    """Newton's method with a small ridge; a single class gives its smoothed share."""
    if len(set(y.tolist())) < 2:
        model.constant = float((y.sum() + 0.5) / (len(y) + 1)) if len(y) else 0.0
        return
    model.mean, model.scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - model.mean) / model.scale])
    w, ridge = np.zeros(z.shape[1]), np.diag([1e-6] + [1.0] * x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + ridge, z.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    model.constant, model.weights = float(w[0]), w[1:]


def sample_ids(labels: DataFrame, id: str = "doc_id", label: str = "toxic", sample_texts: int = SAMPLE_TEXTS) -> DataFrame:
    """At most ``sample_texts`` rows (id, label) of each class, those of least hash of the id: small enough to broadcast."""
    ids = labels.select(id, label).where(F.col(id).isNotNull())
    return reduce(DataFrame.unionByName, (ids.where(F.col(label) == k).orderBy(F.xxhash64(id), id).limit(sample_texts) for k in (0, 1)))


def class_counts(df: DataFrame, label: str = "toxic") -> dict[int, int]:
    return {r["cls"]: r["n"] for r in df.where(F.col(label).isin(0, 1)).groupBy(F.col(label).alias("cls")).agg(F.count("*").alias("n")).collect()}


def train(df: DataFrame, text: str = "text", label: str = "toxic", sample_texts: int = SAMPLE_TEXTS, counts: dict[int, int] | None = None) -> ToxicityModel:
    """Fit on at most ``sample_texts`` different texts of each class (label 1 or 0; others and null texts are left out).

    The dictionaries' part comes to the driver; the rest is measured on the executors, whole. ``counts`` says how many
    rows each class has where df is a sample already. Where no labelled text is left to calibrate on, every text's score is
    the smoothed share of label 1, and 0 without any labels.
    """
    rows = df.where(F.col(label).isin(0, 1))
    sample = class_sample(rows, label, text, sample_texts)
    part = F.pmod("k", F.lit(20)) < int(20 * DICTIONARY_SHARE)
    drawn = sample.where(part).orderBy("cls", "k").collect()
    model = fit_dictionaries([words(r["text"]) for r in drawn if r["cls"] == 1], [words(r["text"]) for r in drawn if r["cls"] == 0])
    share = class_counts(rows, label) if counts is None else counts
    measured = measure(sample.where(~part).select("cls", "text"), model).collect()
    if not measured:
        model.constant = (share.get(1, 0) + 0.5) / (sum(share.values()) + 1) if share else 0.0
        return model
    x, y = np.array([r["gains"] for r in measured]).reshape(len(measured), -1), np.array([float(r["cls"]) for r in measured])
    fit_logistic(model, x, y)
    if model.weights is not None:  # the sample holds the classes in another ratio than the labels do
        of = lambda a: np.log(max(a.get(1, 0), 0.5) / max(a.get(0, 0), 0.5))
        model.constant += of(share) - of(Counter(y.astype(int).tolist()))
    return model


def measure(df: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(model)
    extra = T.StructType([T.StructField("gains", T.ArrayType(T.DoubleType()))])
    return map_text(df, text, extra, lambda texts: ([shared.value.features(t) for t in texts],))


def score(df: DataFrame, model: ToxicityModel, text: str = "text", out: str = "score") -> DataFrame:
    """df with ``out``: 0 to 1, higher where label 1 is likelier, from each whole text.

    A null or empty text is one empty window and has its score as well. A column named like ``out`` is replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    extra = T.StructType([T.StructField(out, T.DoubleType())])
    return map_text(df, text, extra, lambda texts: ([shared.value.score(shared.value.features(t)) for t in texts],))
