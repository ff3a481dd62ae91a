"""The registered queries of the corpus operators: thin, over whole tables."""

from __future__ import annotations

import string

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from idweave.llm import bpe, decontamination, hnsw, langid, lexical, licenses, line_dedup, ngram_join, packing, quality, repeats, terms, toxicity, vector_codes
from idweave.llm.common import small_batches, table


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of cosine 0.98 or more between vectors of a label, and their components."""
    return hnsw.near_vectors(table(spark, sf_dir, "embeddings"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids in sequences of at most 2048, by cutting-stock patterns; pieces' ids as a checksum."""
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more: classes, link counts, components."""
    return ngram_join.near_documents(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, sentences, paragraphs and texts that are a licence notice by the Dice coefficient over word bigrams."""
    templates = spark.createDataFrame(list(licenses.TEMPLATES.items()), "license string, text string")
    return licenses.scan(table(spark, sf_dir, "documents"), templates)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without strings of 50 bytes that also start in a smaller document, as a digest."""
    done = repeats.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return done.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict on every document; documents labelled of good quality are the trusted target."""
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("quality = 1").select("doc_id"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document with the first line of its component of near copies, which alone is kept."""
    return line_dedup.mark_lines(table(spark, sf_dir, "documents"))


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document by forced-boundary BPE, and the text decoded from them, as digests."""
    small_batches(spark)
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = bpe.decode(bpe.encode(docs, path, "text", "ids").drop("text"), path, "ids", "decoded")
    return done.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.ToxicityModel:
    """Learned from labelled documents of the folds for learning."""
    labels = table(spark, sf_dir, "labels").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).select("doc_id", "toxic")
    chosen = toxicity.sample_ids(labels)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return toxicity.train(docs, counts=toxicity.class_counts(labels))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of every document, by compression distance."""
    small_batches(spark)
    model = toxicity_model(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"))
    return toxicity.score(docs, model).select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, by Kneser-Ney character models."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.crc32(F.col("doc_id").cast("string")) % 4 == 2)
    model = langid.train(docs.where(~F.col("held_out")).select("lang", "text"))
    return langid.predict(docs.select("doc_id", "text", "held_out"), model).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest-scoring documents for every benchmark item, score at a time."""
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's code in eight parts of sixteen entries, its error and its label's, by exponion search."""
    done = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    return done.codes.withColumn("codebooks_sha256", F.lit(done.digest()))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that stand in a ten-word window of a benchmark item, and the items, by FM-indexes."""
    found = decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    listed = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


QUERIES = {f.__name__: f for f in (op1_embedding_near_dedup, op2_packing, op4_ngram_jaccard_join, op5_license_scan, op6_suffix_dedup, op3_toxicity, op7_quality_rules, op8_line_dedup, op9_bpe_round_trip, op10_language_id, op11_ranked_search, op12_vector_codes, op13_decontamination)}
QUOTED = ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in pair)) for pair in licenses.TEMPLATES.items())
WORDS = "regexp_extract_all(lower({0}), '[a-z0-9]+')"
PAIRS = "list_distinct(list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1]))"
OP5_SQL = f"""
WITH template AS (SELECT license, unnest(g) AS g, len(g) AS b FROM (SELECT license, {PAIRS.format('w')} AS g FROM (SELECT license, {WORDS.format('t')} AS w FROM (VALUES {QUOTED}) AS v(license, t)))),
p AS (SELECT doc_id, coalesce(text, '') AS t, regexp_split_to_array(coalesce(text, ''), '{licenses.SENTENCE_END}') AS ss, regexp_split_to_array(coalesce(text, ''), '\n[\x20\x09-\x0D]*\n') AS ps FROM documents),
segment AS (
  SELECT doc_id, 'line' AS kind, unnest(range(len(l))) AS segment_no, unnest(l) AS part FROM (SELECT doc_id, string_split(t, chr(10)) AS l FROM p)
  UNION ALL SELECT doc_id, 'sentence', unnest(range(len(ss))), unnest(ss) FROM p WHERE len(ss) > 1
  UNION ALL SELECT doc_id, 'paragraph', unnest(range(len(ps))), unnest(ps) FROM p
  UNION ALL SELECT doc_id, 'text', 0, t FROM p WHERE len(ps) > 1),
own AS (SELECT doc_id, kind, segment_no, {PAIRS.format('w')} AS g FROM (SELECT *, {WORDS.format('part')} AS w FROM segment WHERE kind <> 'paragraph' OR contains(part, chr(10)))),
hit AS (
  SELECT doc_id, kind, segment_no, license, 2.0 * count(*) / (any_value(a) + any_value(b)) AS dice
  FROM (SELECT doc_id, kind, segment_no, unnest(g) AS x, len(g) AS a FROM own) JOIN template ON x = template.g GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, kind, segment_no ORDER BY round(dice, 12) DESC, license) AS k FROM hit WHERE dice >= {licenses.LEAST} - 1e-9)
SELECT doc_id, kind, segment_no::BIGINT AS segment_no, license, round(dice, 6) AS dice FROM best WHERE k = 1
"""

#: Exact Jaccard similarity through shared shingles, and components by following links (on the driver's small tables).
OP4_SQL = """
WITH RECURSIVE word AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
own AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS g FROM word),
shingle AS (SELECT doc_id, unnest(g) AS s, len(g) AS n FROM own),
link AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) = any_value(a.n) AND count(*) = any_value(b.n) AS same
  FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
  HAVING count(*) >= 0.8 * (any_value(a.n) + any_value(b.n) - count(*)) - 1e-9),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
component AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, least(d.doc_id, coalesce(min(b) FILTER (WHERE same), d.doc_id)) AS class_id, count(b) AS n_links, any_value(component_id) AS component_id, d.doc_id = any_value(component_id) AS kept
FROM documents d LEFT JOIN link ON link.a = d.doc_id JOIN component c ON c.doc_id = d.doc_id GROUP BY d.doc_id
"""

#: Cosines of all pairs of a label, and components by following links (on the driver's small tables).
OP1_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
sound AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
component AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN component c ON c.a = vec_id LEFT JOIN degree d ON d.a = vec_id
"""

TERMS = f"regexp_extract_all(translate({{0}}, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{terms.PATTERN}')"

OP11_SQL = f"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, {TERMS.format('text')} AS w FROM documents),
held AS (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n FROM doc WHERE len(w) > 0),
whole AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM held),
tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM doc) GROUP BY r, t),
weight AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, whole GROUP BY t),
asked AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest({TERMS.format('text')}) AS t FROM benchmark) GROUP BY item_id, t),
scored AS (
  SELECT item_id, r, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total)))) AS BIGINT) AS score
  FROM asked JOIN weight USING (t) JOIN tf USING (t) JOIN held USING (r), whole GROUP BY item_id, r)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored JOIN held USING (r) WHERE score > 0 QUALIFY rank <= 20
"""


def op12_sql(parts: int = vector_codes.PARTS, entries: int = vector_codes.ENTRIES, rounds: int = vector_codes.ROUNDS) -> str:
    """Every round is a table of codes, by all distances, and one of codebooks."""
    floor = "CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)"
    steps = [
        f"kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: {floor}) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"part AS (SELECT vec_id, label, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS x FROM kept, range({parts}) AS t(p))",
        f"book0 AS (SELECT p, e, x AS c FROM part JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept QUALIFY e < {entries}) USING (vec_id))",
    ]
    for k in range(rounds + 1):
        distance = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
        steps.append(f"code{k} AS MATERIALIZED (SELECT vec_id, any_value(label) AS label, p, min((d, e)) AS best, any_value(x) AS x FROM (SELECT part.*, e, CAST({distance} AS BIGINT) AS d FROM part JOIN book{k} USING (p)) GROUP BY vec_id, p)")
        if k < rounds:
            down = "CAST((sum(y) - ((sum(y) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT)"
            steps.append(f"mean{k} AS (SELECT p, e, list(m ORDER BY i) AS c FROM (SELECT p, best[2] AS e, i, {down} AS m FROM (SELECT p, best, unnest(x) AS y, unnest(range(len(x))) AS i FROM code{k}) GROUP BY p, best[2], i) GROUP BY p, e)")
            steps.append(f"book{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN mean{k} m ON m.p = b.p AND m.e = b.e)")
    return f"""WITH {", ".join(steps)},
done AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', CAST(best[2] AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(best[1]) AS BIGINT) AS error FROM code{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM book{rounds}) AS codebooks_sha256 FROM done"""


WINDOW_OF = "array_to_string(w[i : i + least(len(w), {0}) - 1], ' ')"
OP13_SQL = f"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, coalesce({TERMS.format('text')}, []) AS w FROM documents),
item AS (SELECT item_id, {TERMS.format('text')} AS w FROM benchmark),
phrase AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: {WINDOW_OF.format(10)})) AS t FROM item WHERE len(w) > 0),
place AS (SELECT r, n, unnest(range(1, len(w) - n + 2)) AS i, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i : i + n - 1], ' '))) AS t FROM doc, (SELECT DISTINCT n FROM phrase) WHERE len(w) >= n),
found AS (SELECT r, i, n, item_id FROM place JOIN phrase USING (n, t)),
hit AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS place FROM (SELECT DISTINCT r, i, n FROM found)) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT r, item_id FROM found) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""

ORACLE_SQL: dict[str, str] = {"op1_embedding_near_dedup": OP1_SQL, "op4_ngram_jaccard_join": OP4_SQL, "op5_license_scan": OP5_SQL, "op11_ranked_search": OP11_SQL, "op12_vector_codes": op12_sql(), "op13_decontamination": OP13_SQL}
