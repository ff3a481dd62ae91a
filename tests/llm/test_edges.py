"""Empty tables, clashing names, nulls and repeated rows; values compared, not only names."""

import math
import random
import time

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from idweave.llm import hnsw, line_dedup, quality, queries, repeats, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture
def empty(spark, tmp_path):
    for name in ("documents", "labels", "embeddings", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).count() == 0


def test_empty_pipeline(spark, empty):
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_toxicity_without_labels(spark):
    df = spark.createDataFrame([(1, "some words", None), (2, None, None)], "doc_id long, text string, toxic int")
    assert [r["score"] for r in toxicity.score(df, toxicity.train(df)).collect()] == [0.0, 0.0]
    one = spark.createDataFrame([(1, "some words", 1)], "doc_id long, text string, toxic int")
    assert 0 < toxicity.score(df, toxicity.train(one)).first()["score"] <= 1


def test_clashing_names_keep_their_values(spark):
    text = "a line of some length that stands twice in here\n" * 2 + "x" * 60
    df = spark.createDataFrame([(1, text, "p1", 7, "g1"), (2, text, "p2", 8, "g2"), (2, text, "p3", 9, "g3"), (3, None, "p4", 1, None)], "doc_id long, text string, part string, gone_id int, gone_lines string")
    extra = lambda out: sorted((r["part"], r["gone_id"], r["gone_lines"] or "") for r in out.collect())
    assert extra(repeats.without_repeats(df)) == extra(line_dedup.drop_lines(df)) == extra(df)
    left = {r["part"]: r["text"] for r in line_dedup.drop_lines(df).collect()}
    assert left == {"p1": "a line of some length that stands twice in here\n" + "x" * 60, "p2": "", "p3": "", "p4": None}


def test_nulls_and_repeats_through_the_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.limit(3).selectExpr("doc_id + 500000 as doc_id", "cast(null as string) as text", "lang", "source", "n_chars").unionByName(docs.limit(1).selectExpr("cast(null as long) as doc_id", "text", "lang", "source", "n_chars"))
    docs = docs.unionByName(odd).unionByName(docs.limit(5))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.where("doc_id >= 500000 and text is null").count() == 3, name
        assert out.columns == docs.columns
    assert corpus_pipeline.STAGES[-1][1](spark, odd.where("doc_id is not null"), SF).selectExpr("sum(length)").first()[0] == 3


def test_many_shards(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(5000, 24))
    x[4000:4600] = x[:600] + rng.normal(size=(600, 24)) * 0.12 * np.abs(rng.normal(size=(600, 1)))
    x[4600:4900] = x[100] + rng.normal(size=(300, 24)) * 0.1
    df = spark.createDataFrame([(k, v.tolist(), "only") for k, v in enumerate(x)], "vec_id long, embedding array<double>, label string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in hnsw.near_vectors(df, shard_rows=1300).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = unit @ unit.T >= 0.98
    tree = hnsw.forest(*np.nonzero(link))
    assert link.sum() > 20_000 and got == {k: (int(link[k].sum()) - 1, tree[k]) for k in range(len(x))}


def test_graphs_answer_small_groups():
    x = hnsw.unit(np.random.default_rng(2).normal(size=(59, 16)).tobytes(), 16)
    graph = hnsw.Graph(x)
    graph.all_within = None  # brute force is for beams as large as the shard only
    q, v = hnsw.links_of(graph, x, x, 0.98)
    assert sorted(zip(q.tolist(), v.tolist())) == [(k, k) for k in range(59)]


def test_quality_verdict_by_brute_force(spark):
    own = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    trusted = own.where("doc_id % 3 = 0").select("doc_id")
    got = {r["doc_id"]: r for r in quality.judge(own, trusted).collect()}

    def grams(text):
        words = [w for w in "".join(" " if c in quality.SPACE else c for c in text or "").split(" ") if w]
        one = lambda w, seed=42: xxhash.xxh64(w.encode(), seed=seed).intdigest()
        signed = lambda h: h - (1 << 64) if h >> 63 else h
        return [signed(one(w)) % quality.BUCKETS for w in words] + [signed(one(b, one(a))) % quality.BUCKETS for a, b in zip(words, words[1:])]

    every = {r["doc_id"]: grams(r["text"]) for r in own.collect()}
    raw, target = np.zeros(quality.BUCKETS), np.zeros(quality.BUCKETS)
    for i, g in every.items():
        np.add.at(raw, g, 1)
        np.add.at(target, g, int(i % 3 == 0))
    weight = np.log((target + 1) / (target.sum() + quality.BUCKETS)) - np.log((raw + 1) / (raw.sum() + quality.BUCKETS))
    llr = {i: float(weight[g].mean()) if g else 0.0 for i, g in every.items()}
    assert all(abs(got[i]["llr"] - llr[i]) < 1e-6 for i in every)
    sound = sorted(llr[i] for i in every if i % 3 == 0 and not got[i]["base_failed"])
    least = math.floor(sound[math.ceil(quality.QUANTILE * len(sound)) - 1] / quality.STEP) * quality.STEP - quality.MARGIN
    assert {i: got[i]["kept"] for i in every} == {i: not got[i]["base_failed"] and llr[i] >= least for i in every}


def test_hot_anchors(spark):
    rng = np.random.default_rng(9)
    text = lambda n: "".join(rng.choice(list("abcdefghij "), n))
    passage = text(140)
    rows = [(k, text(60) + passage + (text(60) if k % 3 else "same ending of some length, always the same, without any change")) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    seen: dict = {}
    want = {}
    for k, t in rows:
        gone = bytearray(len(t))
        for i in range(len(t) - 49):
            if seen.setdefault(t[i : i + 50], k) < k:
                gone[i : i + 50] = b"\1" * 50
        want[k] = "".join(c for c, g in zip(t, gone) if not g)
    for hot in (4, repeats.HOT):
        assert {r["doc_id"]: bytes(r["kept"]).decode() for r in repeats.without_repeats(df, hot=hot).collect()} == want


def test_stages_chain_and_read_again(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lines = corpus_pipeline.without_repeated_lines(spark, docs, SF)
    seen = sorted((r["doc_id"], r["text"]) for r in lines.collect())
    both = corpus_pipeline.without_repeated_passages(spark, lines, SF)  # nothing is written in between
    corpus_pipeline.without_toxic(spark, docs, SF).count()  # a stage of another pipeline
    assert sorted((r["doc_id"], r["text"]) for r in lines.collect()) == seen
    once = sorted((r["doc_id"], r["text"]) for r in both.collect())
    assert once == sorted((r["doc_id"], r["text"]) for r in both.collect()) and len(once) == len(seen)


def test_stages_leave_little_behind(spark):
    from idweave.llm.common import noting

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop
    for name, stage in corpus_pipeline.STAGES[:-1]:
        with noting() as used:
            stage(spark, docs, SF).count()
        there = [t.path for t in used if hadoop.fs.FileSystem.getLocal(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop.fs.Path(t.path.removeprefix("file:")))]
        assert len(there) <= 1, (name, there)


def test_a_million_hot_anchors():
    rng = np.random.default_rng(0)
    hot = np.sort(rng.integers(0, 1 << 48, 1_000_000).astype(np.uint64))
    began = time.perf_counter()
    for _ in range(200):
        some = np.concatenate([rng.integers(0, 1 << 48, 300).astype(np.uint64), hot[rng.integers(0, len(hot), 20)]])
        assert np.array_equal(repeats.among(some, hot)[-20:], np.full(20, True))
    assert time.perf_counter() - began < 5
    assert not repeats.among(some, hot[:0]).any()


def test_license_rows_repeat_behind_a_shuffle(spark):
    text = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"
    from idweave.llm import licenses

    templates = spark.createDataFrame([("one", text)], "license string, text string")
    rows = [(1, text), (1, text), (1, text + " twice"), (2, text), (None, text), (None, text), (3, None)]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), templates).where("kind = 'line'").collect()
    assert sorted((str(r["doc_id"]), r["dice"]) for r in got) == sorted([("1", 1.0)] * 2 + [("1", got_dice(text, text + " twice"))] + [("2", 1.0)] + [("None", 1.0)] * 2)


def got_dice(a, b):
    pairs = lambda t: set(zip((w := t.lower().replace(",", "").split()), w[1:]))
    return round(2 * len(pairs(a) & pairs(b)) / (len(pairs(a)) + len(pairs(b))), 6)


def test_sketches_tell_small_and_large_sets_apart(spark):
    rng = random.Random(3)
    texts = ["ab", "abcde", "ä" * 40, *["".join(rng.choice("abcdefgh é") for _ in range(n)) for n in (30, 99, 101, 700)]]
    got = {r["k"]: r for r in line_dedup.sketches(spark.createDataFrame(list(enumerate(texts)), "k long, line string").repartition(2, "k")).collect()}
    hashes = {r["k"]: set(r["h"]) for r in line_dedup.shingle_rows(spark.createDataFrame(list(enumerate(texts)), "k long, line string")).groupBy("k").agg(F.collect_set("h").alias("h")).collect()}
    for k, x in enumerate(texts):
        own = {x[i : i + 5] for i in range(max(1, len(x) - 4))}
        assert got[k]["n"] == len(own) == len(hashes[k])
        for stem, words in (("w", line_dedup.WORDS), ("v", line_dedup.WIDE_WORDS)):
            want = [sum({1 << (h & 63) for h in hashes[k] if (h >> 6) % words == i}) for i in range(words)]
            have = [got[k][f"{stem}{i}"] for i in range(words)]
            assert have == ([None] * words if stem == "v" and len(own) <= line_dedup.LONG else [v - (v >> 63 << 64) for v in want])


def test_only_texts_that_lose_lines_are_dealt(spark, tmp_path):
    texts = [f"line {k} of its own, {k * 7919} and {k * 104729}" for k in range(50)]
    rows = [(k, x, "p") for k, x in enumerate(texts)] + [(60, texts[3] + "\n" + "other words stand here alone", "q"), (None, texts[4], "r"), (61, None, "s")]
    spark.createDataFrame(rows, "doc_id long, text string, part string").write.parquet(str(tmp_path / "docs"))
    out = line_dedup.drop_lines(spark.read.parquet(str(tmp_path / "docs")))
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["text"]) for r in out.where("text is not null").collect()) == sorted([*enumerate(texts), (60, "other words stand here alone"), (-1, texts[4])])
    assert out.where("text is null").count() == 1 and " Union" in f" {out._jdf.queryExecution().optimizedPlan().toString()}"
