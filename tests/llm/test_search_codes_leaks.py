"""Ranked search, vector codes and decontamination against brute force, with nulls, ties, repeats, long texts and many shards."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from idweave.llm import decontamination, fm_index, lexical, terms, vector_codes

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def test_terms():
    text = "Ärger ÄB-c\x00d  É9_x^y Ünï z " + "ab," * 400
    assert [w.decode() for piece in terms.words(text, 64) for w in piece] == terms_of(text)
    assert list(terms.words(None)) == [] and [p for p in terms.words("x" * 300, 64)] == [[b"x" * 300]]


def ranked(docs, items, k):
    own = [(i, terms_of(t)) for i, t in docs]
    n_docs, total = sum(bool(w) for _, w in own), sum(len(w) for _, w in own)
    df = Counter(t for _, w in own for t in set(w))
    out = []
    for item, text in items:
        scores = []
        for i, w in own:
            if w:
                tf, m = Counter(w), 75 + 25 * len(w) * n_docs // total
                s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * tf[t]) // (1000 * tf[t] + 12 * m)) for t in terms_of(text) if t in tf)
                if s > 0:
                    scores.append((-s, i is None, i or 0, i))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


def corpus(rng, n, words):
    return [(k, " ".join(rng.choices(words, weights=[1 / (j + 1) for j in range(len(words))], k=rng.randrange(60)))) for k in range(n)]


@pytest.mark.parametrize("pairs,postings", [(10**6, 10**6), (200, 300)])
def test_search_equals_scoring_all(spark, pairs, postings):
    rng = random.Random(1)
    words = [f"w{j}" for j in range(150)]
    docs = corpus(rng, 700, words) + [(9001, None), (9002, ""), (None, "w3 w9 w100"), (5, "W3 w140"), (5, "W3 w140"), (9003, "w149 " * 4000)] + [(10000 + k, "w120 w121") for k in range(60)]
    items = [(k, " ".join(rng.choices(words, k=rng.randrange(1, 25)))) for k in range(25)] + [(50, "w120 w121 w120"), (51, None), (52, "none of these"), (None, "w3 w9"), (0, "another text w7"), (1, "  ")]
    rows = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, rank string").repartition(3)
    asked = spark.createDataFrame(items + items[:2], "item_id long, text string")  # repeated items are one
    got = lexical.search(rows, asked, k=20, most_pairs=pairs, shard_postings=postings).collect()
    assert sorted((tuple(r) for r in got), key=str) == ranked(docs, items, 20)


def test_search_stops_early():
    """Of postings by falling impact only the first are added up where the best are clear."""
    rng = np.random.default_rng(0)
    n = 5000
    terms_ = np.repeat([0, 1], n)
    times = np.concatenate([np.ones(n, int), np.where(np.arange(n) < 30, 9, 1)])
    order = np.lexsort((terms_, np.tile(np.arange(n), 2)))
    shard = lexical.Shard(np.arange(n), np.ones(n, bool), np.full(n, 2), terms_[order], times[order], np.full(n, 100) + rng.integers(0, 3, n))
    value = np.array([1, 5000])
    docs, score = shard.best(np.array([0, 1]), value, 20, 0)
    whole = shard.whole(np.arange(n), value)
    best = np.sort(whole)[::-1][:20]
    assert len(docs) < n and np.array_equal(np.sort(score)[::-1][:20], best) and np.array_equal(whole[docs], score)


def by_hand(rows):
    kept = [(i, [math.floor(4096 * x) for x in v], l) for i, v, l in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    x = np.array([v for _, v, _ in kept], object)
    d = x.shape[1] // 8
    seeds = []
    for i, v, _ in sorted((r for r in kept if r[0] is not None), key=lambda r: (r[0], r[1])):
        if not seeds or seeds[-1][0] != i:
            seeds.append((i, v))
    books = [[list(v[p * d : p * d + d]) for _, v in seeds[:16]] for p in range(8)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(r[p * d : p * d + d], e)), k) for k, e in enumerate(books[p])) for p in range(8)] for r in x]

    for _ in range(6):
        codes = assign()
        for p in range(8):
            for k in range(len(books[p])):
                own = [r[p * d : p * d + d] for r, c in zip(x, codes) if c[p][1] == k]
                if own:
                    books[p][k] = [sum(c) // len(own) for c in zip(*own)]
    codes = assign()
    error = [sum(c[0] for c in own) for own in codes]
    label = Counter()
    for (_, _, l), e in zip(kept, error):
        label[l] += e
    digest = hashlib.sha256(",".join(str(v) for p in books for e in p for v in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{c[1]:02x}" for c in own), e, label[l]) for (i, _, l), own, e in zip(kept, codes, error)), key=str), digest


@pytest.mark.parametrize("n,d", [(400, 16), (9, 8), (1, 24)])
def test_codes_equal_all_distances(spark, n, d):
    rng = np.random.default_rng(n)
    rows = [(int(k), [float(np.float32(v)) for v in rng.normal(size=d)], int(rng.integers(3)) or None) for k in rng.permutation(n)]
    rows += [(rows[0][0], rows[0][1], rows[0][2])] * 3  # repeated rows
    if n > 100:
        rows += [(None, [0.5] * d, 1), (-3, None, 1), (-2, [1.0] * (d - 1) + [None], 2), (-1, [float("nan")] * d, 2), (-1, [float("inf")] + [0.0] * (d - 1), 2)] + [(1000 + k, [0.25] * d, 7) for k in range(40)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, code string").repartition(3)
    made = vector_codes.compress(df)
    want, digest = by_hand(rows)
    assert sorted((tuple(r) for r in made.codes.select("vec_id", "code", "error", "label_error").collect()), key=str) == want
    assert made.digest() == digest


def test_codes_leave_out_what_does_not_fit(spark):
    rows = [(1, [0.5] * 16, 1), (2, [0.5] * 8, 1), (3, [0.5] * 7, 1), (4, [], 1), (5, [1e30] + [0.0] * 15, 1), (6, [-0.00001] * 16, 1)]
    got = vector_codes.compress(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).codes.collect()
    assert sorted((r["vec_id"], r["error"]) for r in got) == [(1, 0), (6, 0)]


def test_exponion_looks_at_all_that_may_win():
    rng = np.random.default_rng(2)
    for scale in (2, 50, 10**6):
        x, book = rng.integers(-scale, scale, (500, 4)), rng.integers(-scale, scale, (16, 4))
        book[5] = book[3]
        code, least = vector_codes.nearest(x, book, rng.integers(0, 16, 500).astype(np.uint8))
        every = ((x[:, None] - book[None]) ** 2).sum(2)
        assert np.array_equal(code, every.argmin(1)) and np.array_equal(least, every.min(1))


def test_fm_index():
    rng = np.random.default_rng(3)
    parts = [rng.integers(1, 6, n) for n in (1, 40, 300, 17, 300)] + [np.tile([1, 2, 3], 90)] * 3
    text = np.concatenate([np.append(p, 0) for p in parts]).astype(np.int32)
    index = fm_index.FmIndex.loaded(fm_index.FmIndex.of(text, 6).saved())
    phrases = [list(text[k : k + n]) for n in (1, 2, 5, 10) for k in range(0, len(text) - n, 7) if 0 not in text[k : k + n]] + [[5] * 10]
    padded = np.array([[0] * (10 - len(p)) + p for p in phrases])
    low, high = index.search(padded, np.array([len(p) for p in phrases]))
    for p, a, b in zip(phrases, low, high):
        want = [k for k in range(len(text)) if list(text[k : k + len(p)]) == p]
        assert sorted(index.located(np.arange(a, b)).tolist()) == want
    assert high[-1] == low[-1] or [5] * 10 in [list(text[k : k + 10]) for k in range(len(text))]


def hits(docs, items):
    out = []
    windows = {}
    for item, text in items:
        w = terms_of(text)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(item)
    for i, text in docs:
        w, hit, found = terms_of(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                own = windows.get(tuple(w[k : k + n]))
                if own:
                    hit |= set(range(k, k + n))
                    found |= own - {None}
        out.append((i, len(w), len(hit), tuple(sorted(found))))
    return sorted(out, key=str)


@pytest.mark.parametrize("short,most", [(False, 10**6), (True, 10**6), (True, 120)])
def test_leaks_equal_brute_force(spark, short, most, monkeypatch):
    monkeypatch.setattr(decontamination, "SEGMENT", 24)
    rng = random.Random(4)
    words = [f"w{j}" for j in range(40)]
    items = [(k, " ".join(rng.choices(words, k=rng.choice((10, 12, 25))))) for k in range(20)] + [(None, " ".join(words[:11])), (3, " ".join(words[5:18])), (70, None), (71, ""), (72, " ".join(words[5:18]))]
    items += [(80, "W1"), (81, "w2 w2"), (82, "w3 w4 w5")] if short else []
    docs = [(k, " ".join(rng.choices(words + ["other", "Ö"], k=rng.randrange(80)))) for k in range(120)]
    docs += [(500 + k, f"junk {text.upper() if k % 2 else text}, and {text} tail") for k, (_, text) in enumerate(items) if text]
    docs += [(900, None), (901, ""), (None, items[0][1]), (500, docs[0][1]), (500, docs[0][1]), (902, " ".join(words * 30) + " x"), (903, items[2][1] + " " + items[2][1])]
    rows = spark.createDataFrame([(i, t, "q") for i, t in docs], "doc_id long, text string, spans string").repartition(3)
    found = decontamination.contaminated(rows, spark.createDataFrame(items, "item_id long, text string"), most_words=most)
    got = sorted(((r["doc_id"], r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), tuple(sorted(r["items"]))) for r in found.collect()), key=str)
    assert got == hits(docs, items)
    for r in found.collect():
        edges = [x for s in r["spans"] for x in (s["start"], s["end"])]
        assert edges == sorted(set(edges))


def test_spans_are_cut_out(spark):
    item = " ".join(f"t{k}" for k in range(12))
    docs = spark.createDataFrame([(1, f"Before, {item.upper()}! After.", "a"), (2, "clean text", "b"), (3, None, "c"), (None, item, "d")], "doc_id long, text string, more string")
    found = decontamination.contaminated(docs, spark.createDataFrame([(1, item)], "item_id int, text string"))
    left = {r["more"]: r["text"] for r in decontamination.without_spans(docs, found).collect()}
    assert left == {"a": "Before, ! After.", "b": "clean text", "c": None, "d": item}


def test_nothing_to_look_for(spark):
    docs = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([(1, None), (2, "  ")], "item_id long, text string")
    assert lexical.search(docs, none).collect() == []
    assert sorted((r["doc_id"], r["n_words"], r["spans"], r["items"]) for r in decontamination.contaminated(docs, none).collect()) == [(1, 2, [], []), (2, 0, [], [])]
