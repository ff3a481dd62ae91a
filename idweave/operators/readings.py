"""Readings of a field: fragments put together, two engines weighed, the best attempt, conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from idweave.functions.binding import bind, named
from idweave.functions.codes import is_valid
from idweave.functions.text import only_digits
from idweave.functions.vectors import dot, doubles, soft_iou
from idweave.operators.sizes import small

AGREED, TEMPLATE_LEAST, TEMPLATE_ALONE, CONFLICT = 0.2, 0.9, 0.85, 0.5
WEAK_TEXT, WEAK_ALL = 0.85, 0.30
ATTEMPTS = ["soft", "binary", "raw"]


def joined_fragments(fragments: DataFrame, keys: list[str], right_to_left: bool = False, separator: str = "") -> DataFrame:
    """keys, text, confidence of fragments (cx, ord, text, confidence), by their centre's place.

    Blank fragments add nothing to the text and count in the mean confidence; ties keep the order of ord.
    """
    place = -F.col("cx") if right_to_left else F.col("cx")
    piece = F.struct(place.alias("at"), F.col("ord"), F.trim("text").alias("text"))
    all_ = F.array_sort(F.collect_list(piece))
    text = F.array_join(F.filter(F.transform(all_, lambda p: p["text"]), lambda t: t != ""), separator)
    return fragments.groupBy(*keys).agg(text.alias("text"), F.avg("confidence").alias("confidence"))


def is_date8(digits: Column) -> Column:
    part = lambda a, n: F.substring(digits, a, n).try_cast("int")
    return F.coalesce(digits.rlike(r"\A[0-9]{8}\z") & part(1, 4).between(1250, 1420) & part(5, 2).between(1, 12) & part(7, 2).between(1, 31), F.lit(False))


def chosen(value: Column, confidence: Column, rule: str) -> Column:
    return F.struct(value.alias("value"), confidence.alias("confidence"), F.lit(rule).alias("rule"))


def weighed_digits(ocr: Column, ocr_c: Column, template: Column, template_c: Column) -> Column:
    """Struct value, confidence, rule of two engines' readings of a number; null or empty is no reading."""
    o, t = F.nullif(ocr, F.lit("")), F.nullif(template, F.lit(""))
    agreed = F.least(F.lit(1.0), F.greatest(ocr_c, template_c) + AGREED)
    return (
        F.when(o.isNotNull() & (t == only_digits(o)), chosen(t, agreed, "agreed"))
        .when(is_valid(t), chosen(t, F.greatest(template_c, F.lit(TEMPLATE_LEAST)), "valid_template"))
        .when(o.isNotNull(), chosen(o, ocr_c, "ocr"))
        .when((F.length(t) == 10) & (template_c >= TEMPLATE_ALONE), chosen(t, template_c, "template"))
        .when(t.isNotNull(), chosen(t, template_c, "template"))
        .otherwise(chosen(F.lit(None).cast("string"), F.lit(0.0), "none"))
    )


def weighed_dates(ocr: Column, ocr_c: Column, template: Column, template_c: Column, again: Column, again_c: Column) -> Column:
    """As weighed_digits, for dates; ``again`` is a second reading that may hold separators."""
    o, t, r = (F.nullif(c, F.lit("")) for c in (ocr, template, again))
    o8 = named(F.nullif(only_digits(o), F.lit("")))
    o_date, t_date = named(is_date8(o8)), named(is_date8(t))
    agreed = F.least(F.lit(1.0), F.greatest(ocr_c, template_c) + AGREED)
    return (
        F.when(o8.isNotNull() & (t == o8), chosen(t, agreed, "agreed"))
        .when(t_date & ~o_date, chosen(t, template_c, "template_date"))
        .when(o_date & ~t_date, chosen(o8, ocr_c, "ocr_date"))
        .when(r.isNotNull(), chosen(r, again_c, "again"))
        .when(o.isNotNull(), chosen(o, ocr_c, "ocr"))
        .when(t.isNotNull(), chosen(t, template_c, "template"))
        .otherwise(chosen(F.lit(None).cast("string"), F.lit(0.0), "none"))
    )


def matched(ocr: DataFrame, template: DataFrame, keys: list[str], also: tuple[str, ...] = ()) -> DataFrame:
    """Two engines' readings (keys, raw, conf) of the same crops side by side: keys, o, oc, t, tc; either may be missing.

    ``also`` are further columns of the first engine's table, so that it is read once.
    """
    side = lambda df, v, c, *more: df.select(*keys, F.col("raw").alias(v), F.col("conf").alias(c), *more)
    both = side(ocr, "o", "oc", *also).join(side(template, "t", "tc"), keys, "full_outer")
    return both.withColumn("oc", F.coalesce("oc", F.lit(0.0))).withColumn("tc", F.coalesce("tc", F.lit(0.0)))


def gated_attempts(readings: DataFrame, keys: list[str]) -> DataFrame:
    """Of readings (keys, kind, attempt, raw, conf) those that are asked for, with attempt_no: each step only where needed.

    The binary crop is read for numbers and dates, and for texts whose soft reading is weak; the raw one where all before
    are very weak. Blank readings count as none.
    """
    said = F.when(F.coalesce("raw", F.lit("")) != "", F.coalesce("conf", F.lit(0.0))).otherwise(0.0)
    surest = lambda name: F.coalesce(F.max(F.when(F.col("attempt") == name, said)).over(Window.partitionBy(*keys)), F.lit(0.0))
    own = readings.withColumn("__soft", surest("soft")).withColumn("__binary", surest("binary"))
    second = F.col("kind").isin("number", "date") | (F.col("__soft") < WEAK_TEXT)
    third = F.greatest("__soft", F.when(second, F.col("__binary")).otherwise(0.0)) < WEAK_ALL
    asked = F.when(F.col("attempt") == "soft", True).when(F.col("attempt") == "binary", second).when(F.col("attempt") == "raw", third).otherwise(False)
    number = F.array_position(F.array(*map(F.lit, ATTEMPTS)), F.col("attempt")).cast("int") - 1
    return own.where(asked).withColumn("attempt_no", number).drop("__soft", "__binary")


def best_reading(readings: DataFrame, keys: list[str]) -> DataFrame:
    """keys, raw, conf, conflict, other of readings (attempt_no, raw, conf): the surest, the first of equals.

    conflict says whether a different reading of a confidence over a half exists as well; other is the surest of them.
    """
    own = readings.where("raw is not null and raw <> '' and conf > 0")
    each = own.groupBy(*keys, "raw").agg(F.max(F.struct(F.col("conf"), (-F.col("attempt_no")).alias("first"))).alias("top"))
    two = each.withColumn("__place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("top")))).where("__place <= 2")
    other = F.max(F.when((F.col("__place") == 2) & (F.col("top.conf") > CONFLICT), F.col("raw")))
    at = lambda c: F.max(F.when(F.col("__place") == 1, F.col(c)))
    return two.groupBy(*keys).agg(at("raw").alias("raw"), at("top.conf").alias("conf"), other.isNotNull().alias("conflict"), other.alias("other"))


def kept_scores(blobs: DataFrame, keys: list[str], floor: float = 0.55, drop: float = 0.35) -> DataFrame:
    """blobs (score) with kept: at least the floor and at most ``drop`` under the best of their group."""
    top = F.max("score").over(Window.partitionBy(*keys))
    return blobs.withColumn("kept", F.col("score") >= F.greatest(F.lit(floor), top - drop))


def upper_median(value: Column) -> Column:
    """Of a list: the value in the middle, the upper one of two."""
    return bind(F.array_sort(value), lambda own: F.get(own, F.floor(F.size(own) / 2).cast("int")))


def median_band(blobs: DataFrame, keys: list[str]) -> DataFrame:
    """blobs (h, cy) with kept: heights near the upper median, then, if any are left, centres near theirs.

    A group is a crop's blobs, so its heights and centres fit a window.
    """
    own = Window.partitionBy(*keys)
    listed = blobs.withColumn("all_", F.collect_list(F.struct("h", "cy")).over(own))
    mid = upper_median(F.transform("all_", lambda b: b["h"]))
    tall = lambda h, m: (h >= 0.5 * m) & (h <= 2.2 * m)
    row = bind(mid, lambda m: F.struct(m.alias("mid"), F.filter("all_", lambda b: tall(b["h"], m)).alias("tall")))
    facts = bind(row, lambda r: F.struct(r["mid"].alias("mid"), r["tall"].alias("tall"), upper_median(F.transform(r["tall"], lambda b: b["cy"])).alias("cy"), upper_median(F.transform(r["tall"], lambda b: b["h"])).alias("h")))
    any_ = bind(facts, lambda f: F.struct(f["mid"].alias("mid"), f["cy"].alias("cy"), f["h"].alias("h"), F.exists(f["tall"], lambda b: F.abs(b["cy"] - f["cy"]) <= 0.7 * f["h"]).alias("any")))
    marked = listed.withColumn("row", any_).where(tall(F.col("h"), F.col("row.mid")))
    return marked.withColumn("kept", (F.abs(F.col("cy") - F.col("row.cy")) <= 0.7 * F.col("row.h")) | ~F.col("row.any")).drop("all_", "row")


def best_template(queries: DataFrame, templates: DataFrame, keys: list[str]) -> DataFrame:
    """keys, label, score: the template (label, ord, vec; a small table) most like each query (vec), the first of equals.

    Both sides bring the product with themselves along, so that each pair takes one product only.
    """
    side = lambda df, p, *more: df.select(*more, doubles(F.col("vec")).alias(f"{p}_vec")).withColumn(f"{p}_norm", dot(F.col(f"{p}_vec"), F.col(f"{p}_vec")))
    pairs = side(queries, "q", *keys).crossJoin(small(side(templates, "t", "label", "ord")))
    scored = pairs.select(*keys, "label", "ord", soft_iou(dot(F.col("q_vec"), F.col("t_vec")), F.col("q_norm"), F.col("t_norm")).alias("score"))
    return scored.groupBy(*keys).agg(F.max_by("label", F.struct(F.col("score"), -F.col("ord"))).alias("label"), F.max("score").alias("score"))
