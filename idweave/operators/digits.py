"""Strings of digits from blobs: size filter, bands, wide blobs cut in two, templates shifted about, assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from idweave.functions.binding import bind
from idweave.functions.vectors import rolled
from idweave.operators.readings import best_template, kept_scores, median_band, upper_median

LEAST_HEIGHT, LEAST_AREA = 8, 12
WIDE, WIDER_THAN_TALL = 1.6, 1.4
LEAST_DIGITS, MOST_DIGITS = 6, 12
REJECT = "reject"


def sized(blobs: DataFrame, least_height: int = LEAST_HEIGHT, least_area: int = LEAST_AREA) -> DataFrame:
    """blobs (h, area) that are no specks."""
    return blobs.where((F.col("h") >= least_height) & (F.col("area") >= least_area))


def cut_at(columns: Column, width: Column) -> Column:
    """Where to cut a blob, given its ink in each column: the first column with least ink in its middle half."""
    low, high = (width * 0.25).cast("int"), (width * 0.75).cast("int")
    return bind(F.slice(columns, low + 1, high - low), lambda middle: F.when(high > low, low + F.array_position(middle, F.array_min(middle)).cast("int") - 1))


def split_wide(blobs: DataFrame, keys: list[str]) -> DataFrame:
    """blobs (w, h, columns) with part, from_x and to_x: one row each, or two where a blob is far wider than its crop's median.

    columns holds the ink of each column; parts lose blank columns at their sides, and blank parts go.
    """
    mid = upper_median(F.collect_list("w").over(Window.partitionBy(*keys)))
    wide = (F.col("w") >= WIDE * F.col("mid_w")) & (F.col("w") >= WIDER_THAN_TALL * F.col("h"))
    ink = lambda a, b: F.filter(F.transform("columns", lambda c, i: F.when((c > 0) & (i >= a) & (i < b), i)), lambda i: i.isNotNull())
    trimmed = lambda a, b: bind(ink(a, b), lambda at: F.when(F.size(at) > 0, F.struct(F.array_min(at).alias("from_x"), (F.array_max(at) + 1).alias("to_x"))))
    whole = F.array(F.struct(F.lit(0).alias("from_x"), F.col("w").cast("int").alias("to_x")))
    own = blobs.withColumn("mid_w", mid).withColumn("cut", F.when(wide, cut_at(F.col("columns"), F.col("w"))))
    parts = F.array_compact(F.array(trimmed(F.lit(0), F.col("cut")), trimmed(F.col("cut"), F.col("w"))))
    parts = F.when(F.col("cut").isNull(), whole).otherwise(bind(parts, lambda p: F.when(F.size(p) > 0, p).otherwise(whole)))
    return own.select(*blobs.columns, F.posexplode(parts).alias("part", "p")).select(*blobs.columns, "part", "p.from_x", "p.to_x")


def shifted(templates: DataFrame, side: int) -> DataFrame:
    """templates (label, ord, vec) in nine places: as they are and rolled by one in every direction.

    Rolling a template one way and a query the other give the same similarity, so queries stay as they are.
    """
    every = [rolled(F.col("vec"), side, down, right) for down in (-1, 0, 1) for right in (-1, 0, 1)]
    return templates.select("label", "ord", F.explode(F.array(*every)).alias("vec"))


def classified(blobs: DataFrame, templates: DataFrame, keys: list[str], side: int = 28) -> DataFrame:
    """keys, label, score: the digit whose template fits best in any of nine places, the first of equals.

    Templates labelled ``reject:`` and then something stand for what is no digit; blobs that fit them best, or fit nothing, are ``reject``.
    """
    best = best_template(blobs, shifted(templates, side), keys)
    nothing = F.col("label").startswith(f"{REJECT}:") | (F.col("score") <= 0)
    return best.select(*keys, F.when(nothing, REJECT).otherwise(F.col("label")).alias("label"), F.greatest("score", F.lit(0.0)).alias("score"))


def assembled(scored: DataFrame, keys: list[str]) -> DataFrame:
    """keys, digits, confidence of classified blobs (x, part, label, score): digits left to right, mean score of the kept.

    Null and 0 where a crop has fewer than ``LEAST_DIGITS`` blobs, or keeps fewer or more than ``MOST_DIGITS`` digits.
    """
    total = scored.groupBy(*keys).agg(F.count("*").alias("blobs"))
    kept = kept_scores(scored.where(F.col("label") != REJECT), keys).where("kept")
    read = kept.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("x", "part", "label"))).alias("all_"), F.avg("score").alias("mean"), F.count("*").alias("n"))
    sound = (F.col("blobs") >= LEAST_DIGITS) & F.col("n").between(LEAST_DIGITS, MOST_DIGITS)
    text = F.array_join(F.transform("all_", lambda p: p["label"]), "")
    return total.join(read, keys, "left").select(*keys, F.when(sound, text).alias("digits"), F.when(sound, F.col("mean")).otherwise(0.0).alias("confidence"))


def banded(blobs: DataFrame, keys: list[str], least_height: int = LEAST_HEIGHT, least_area: int = LEAST_AREA) -> DataFrame:
    """blobs (y, h, area) without specks, and within the bands of height and row of their crop."""
    return median_band(sized(blobs, least_height, least_area).withColumn("cy", F.col("y") + F.col("h") / 2), keys).where("kept").drop("cy", "kept")
