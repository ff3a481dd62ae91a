"""Queries of confusion tables, layouts by date, and approved records, with their SQL; registered with the others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from idweave.functions import confusions, text
from idweave.operators import layout, review
from idweave.operators.sizes import spread
from idweave.plans import cards
from idweave.queries import CARD, CODED, FREE, coded, coded_and_dated, query, table
from idweave.sources import approvals

# Fixed values of the queries: digits that are taken for each other, both ways.
PAIRS = {"0": "5", "5": "0", "6": "8", "8": "63", "3": "8"}


def repairs_sql(pairs: dict[str, str], most_flips: int, most_places: int) -> str:
    """All variants within the changes, digit by digit; then those that are valid."""
    listed = ", ".join(f"('{r}', '{m}')" for r, own in pairs.items() for m in own)
    digits_ = "".join(pairs)
    total = "list_sum(list_transform(range(1, 10), lambda i: CAST({0}[i] AS INT) * (11 - i))) % 11"
    check = "replace({0}, {0}[1], '') <> '' AND CAST({0}[10] AS INT) = CASE WHEN r < 2 THEN r ELSE 11 - r END"
    return f"""WITH RECURSIVE {CODED}, pair(read, meant) AS (VALUES {listed}),
own AS (SELECT *, {total.format('code')} AS r, length(regexp_replace(code, '[^{digits_}]', '', 'g')) AS places FROM coded),
judged AS (SELECT o_orderkey, code, places, {check.format('code')} AS valid FROM own),
v AS (SELECT o_orderkey, code, 0 AS k, 0 AS flips, '' AS t FROM judged WHERE NOT valid AND places BETWEEN 1 AND {most_places}
  UNION ALL SELECT o_orderkey, code, k + 1, flips + c, t || d FROM (SELECT v.*, unnest([0] || list_transform(coalesce(m, []), lambda x: 1)) AS c, unnest([code[k + 1]] || coalesce(m, [])) AS d FROM v LEFT JOIN (SELECT read, list(meant) AS m FROM pair GROUP BY read) ON read = code[k + 1]) WHERE k < 10 AND flips + c <= {most_flips} AND d IS NOT NULL),
fit AS (SELECT o_orderkey, t FROM (SELECT *, {total.format('t')} AS r FROM v WHERE k = 10 AND flips > 0) WHERE {check.format('t')}),
n AS (SELECT o_orderkey, count(*) AS n, min(t) AS t FROM fit GROUP BY 1)
SELECT o_orderkey, CASE WHEN valid THEN 'valid' WHEN n = 1 THEN 'repaired' WHEN n > 1 THEN 'ambiguous' ELSE 'invalid' END AS class, CASE WHEN n = 1 THEN t ELSE code END AS value, coalesce(n, 0) AS repairs FROM judged LEFT JOIN n USING (o_orderkey)"""


@query(repairs_sql(PAIRS, 3, 10))
def code_repair_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = coded(spark, sf_dir).select("o_orderkey", confusions.repair_pairs(F.col("code"), PAIRS, most_places=10).alias("r"))
    return own.select("o_orderkey", "r.*")


# Layouts by date: every 61st order sets up a new layout of one of 40 devices, the 41st has none.
@query("""WITH v AS (SELECT o_custkey % 40 AS device, o_orderdate AS since, max(o_orderkey) AS version_no FROM orders WHERE o_orderkey % 61 = 0 AND o_custkey IS NOT NULL AND o_orderdate IS NOT NULL GROUP BY 1, 2),
c AS (SELECT o_orderkey, o_custkey % 41 AS device, o_orderdate FROM orders)
SELECT o_orderkey, coalesce(version_no, 0) AS version_no, strftime(since, '%Y-%m-%d') AS since, CASE WHEN version_no IS NULL THEN 0 ELSE greatest(0, CAST(trunc((0.367 + version_no % 7 * 0.01) * 1000) AS BIGINT) - greatest(2, CAST(trunc((CAST(trunc((0.822 + version_no % 7 * 0.01) * 1000) AS BIGINT) - CAST(trunc((0.367 + version_no % 7 * 0.01) * 1000) AS BIGINT)) * 0.02::DOUBLE) AS BIGINT))) END AS x1
FROM c ASOF LEFT JOIN v ON c.device = v.device AND c.o_orderdate >= v.since""")
def layout_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    shift = F.col("o_orderkey") % 7 * F.lit(0.01)
    versions = orders.where("o_orderkey % 61 = 0 and o_custkey is not null").select((F.col("o_custkey") % 40).alias("device"), F.col("o_orderdate").alias("valid_from"), F.col("o_orderkey").alias("version_no"), (F.lit(0.367) + shift).alias("x1"), (F.lit(0.822) + shift).alias("x2"))
    shots = orders.select("o_orderkey", (F.col("o_custkey") % 41).alias("device"), F.col("o_orderdate").alias("taken_at"))
    own = layout.layout_as_of(shots, versions, ["device"])
    box = layout.region_box(F.col("version.x1"), F.lit(0.236), F.col("version.x2"), F.lit(0.337), F.lit(1000), F.lit(600))
    return own.select("o_orderkey", F.coalesce("version.version_no", F.lit(0)).alias("version_no"), F.date_format("version.valid_from", "yyyy-MM-dd").alias("since"), F.when(F.col("version").isNotNull(), box["x1"]).otherwise(0).cast("long").alias("x1"))


# Corrections: a user's events, of which the latest counts; a blank one leaves what was read.
@query("""WITH e AS (SELECT user_id, ts, CASE WHEN event_id % 6 = 0 THEN ' ' ELSE event_type END AS last_name FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
l AS (SELECT user_id, max({'t': ts, 'n': last_name}) AS top FROM e GROUP BY 1)
SELECT c_custkey, coalesce(nullif(trim(top.n), ''), c_name) AS last_name, top IS NOT NULL AS approved FROM customer LEFT JOIN l ON l.user_id = c_custkey""")
def approved_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("last_name"))
    said = table(spark, sf_dir, "events").where("user_id is not null and ts is not null")
    fixes = said.select(F.col("user_id").alias("c_custkey"), "ts", F.when(F.col("event_id") % 6 == 0, " ").otherwise(F.col("event_type")).alias("last_name"))
    return review.approved(own, approvals.latest(fixes, ["c_custkey"], "ts"), ["c_custkey"], ["last_name"], "ts")


@query(f"SELECT c_custkey, regexp_replace({FREE}, '[^{text.NAME_CHARACTERS}]', '', 'g') AS letters FROM customer")
def allowed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", text.allowed(F.expr(FREE), text.NAME_CHARACTERS).alias("letters"))


# Engines: a crop of an order is a short text, "first engine's confidence;second engine's;what is written".
class WrittenText:
    """Reads what is written, of numbers and dates the digits; fails on what begins with a question mark."""

    place = 0

    def read(self, images: list[bytes], kind: str) -> list[tuple[str | None, float]]:
        parts = [image.decode().split(";") for image in images]
        if any(p[2].startswith("?") for p in parts):
            raise ValueError("unreadable")
        return [(self.seen(p[2], kind), float(p[self.place])) for p in parts]

    def seen(self, written: str, kind: str) -> str | None:
        return written if kind == "text" else "".join(c for c in written if c in "0123456789")


class WrittenNumbers(WrittenText):
    """The second engine, which reads numbers only."""

    place = 1

    def seen(self, written: str, kind: str) -> str | None:
        return super().seen(written, kind) if kind == "number" else None


class WrittenDates(WrittenText):
    """The first engine again, with separators."""

    def seen(self, written: str, kind: str) -> str | None:
        return written


def crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three fields of every order, in up to three attempts; some crops cannot be cut, on some an engine fails."""
    k = F.col("o_orderkey")
    own = spread(coded_and_dated(spark, sf_dir), "o_orderkey")  # a few parts of files hold many orders
    crop = lambda field, kind, attempt, sure, other, written: F.struct(F.lit(field).alias("field"), F.lit(kind).alias("kind"), F.lit(attempt).alias("attempt"), F.concat_ws(";", sure, F.lit(other), written).cast("binary").alias("image"))
    cut = lambda c: F.when(k % 9 == 0, c.withField("image", F.lit(None).cast("binary"))).otherwise(c)
    every = F.array(
        cut(crop("national_id", "number", "soft", F.lit("0.8"), "0.7", F.col("code"))),
        cut(crop("national_id", "number", "binary", F.lit("0.6"), "0.7", F.translate("code", "8", "3"))),
        cut(crop("national_id", "number", "raw", F.lit("0.95"), "0.95", F.lit("1"))),
        crop("birth_date", "date", "soft", F.lit("0.9"), "0.5", F.col("raw")),
        crop("first_name", "text", "soft", F.when(k % 8 == 1, "0.9").otherwise("0.2"), "0.1", F.when(k % 8 == 0, "?").when(k % 8 == 1, "محمد").otherwise("رضا")),
        crop("first_name", "text", "binary", F.when(k % 8 == 2, "0.1").otherwise("0.75"), "0.1", F.lit("علی")),
        crop("first_name", "text", "raw", F.lit("0.99"), "0.1", F.lit("حسن")),
    )
    return own.select("o_orderkey", F.explode(every).alias("c")).select("o_orderkey", "c.*")


@query(f"""{CARD.split("plain AS")[0]}
e AS (SELECT f.*, code, translate(code, '8', '3') AS other, k % 9 = 0 AS uncut, regexp_replace(raw, '[^0-9]', '', 'g') AS g FROM facts f JOIN state s ON s.o_orderkey = f.k),
d AS (SELECT *, coalesce(length(g) = 8 AND TRY_CAST(g[1:4] AS INT) BETWEEN 1250 AND 1420 AND TRY_CAST(g[5:6] AS INT) BETWEEN 1 AND 12 AND TRY_CAST(g[7:8] AS INT) BETWEEN 1 AND 31, false) AS bare FROM e)
SELECT k AS o_orderkey, CASE WHEN NOT uncut THEN id END AS id, CASE WHEN uncut THEN 0 WHEN class = 'corrected' THEN 0.9 WHEN class = 'repaired' THEN 0.85 ELSE 1 END::DOUBLE AS id_confidence, CASE k % 8 WHEN 1 THEN 'محمد' WHEN 2 THEN 'حسن' ELSE 'علی' END AS name, CASE k % 8 WHEN 1 THEN 0.9 WHEN 2 THEN 0.99 ELSE 0.75 END::DOUBLE AS name_confidence,
  CASE WHEN bare THEN g[1:4] || '/' || g[5:6] || '/' || g[7:8] ELSE jalali END AS birth,
  array_to_string(list_filter([CASE WHEN uncut THEN 'no_crop:national_id' WHEN other <> code THEN 'two_readings:national_id:' || code || '|' || other END, CASE WHEN NOT uncut AND class NOT IN ('valid', 'invalid') THEN class || '_code:national_id' END, CASE WHEN uncut THEN 'no_lines:national_id' END], lambda x: x IS NOT NULL), ';') AS said FROM d""")
def engine_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crops, read by three test engines, weighed, gated and made into records."""
    own = crops(spark, sf_dir)
    lines = spark.createDataFrame([], "o_orderkey long, line_no int, text string, confidence double, cx double, cy double, h double")
    made = cards.records(cards.crop_readings(own, WrittenText, WrittenNumbers, WrittenDates, "o_orderkey"), lines, "o_orderkey")
    said = F.filter("warnings", lambda w: F.contains(w, F.lit("national_id")) | F.contains(w, F.lit("first_name")))
    value, sure = (lambda f: F.col(f"data.{f}")), (lambda f: F.col("confidence")[f])
    return made.select("o_orderkey", value("national_id").alias("id"), sure("national_id").alias("id_confidence"), value("first_name").alias("name"), sure("first_name").alias("name_confidence"), value("birth_date.jalali").alias("birth"), F.array_join(said, ";").alias("said"))
