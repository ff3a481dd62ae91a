"""Thresholds of grey crops from their histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Shares of black outside of which a crop's own threshold is used.
LEAST_BLACK, MOST_BLACK = 0.02, 0.75


def histogram(pixels: DataFrame, keys: list[str], grey: str = "grey") -> DataFrame:
    """keys, grey, n: how many pixels have each value; 256 rows a crop at most, however many pixels it has."""
    return pixels.where(F.col(grey).isNotNull()).groupBy(*keys, F.col(grey).cast("int").alias("grey")).agg(F.count("*").alias("n"))


def thresholds(pixels: DataFrame, keys: list[str], grey: str = "grey") -> DataFrame:
    """keys, threshold, between: the grey value that parts a crop's pixels with most variance between them, the least of equals.

    Values up to the threshold are ink. A crop of one value only has the threshold 0 and nothing between. Prefix sums run over
    the histogram, so no task holds a crop's pixels.
    """
    own = histogram(pixels, keys, grey)
    sums = own.select(*keys, between(keys, F.col("n")).alias("between"), "grey")
    top = F.max(F.struct(F.col("between"), (-F.col("grey")).alias("least"))).alias("top")
    best = sums.groupBy(*keys).agg(top)
    return best.select(*keys, F.when(F.col("top.between") > 0, -F.col("top.least")).otherwise(0).alias("threshold"), F.col("top.between").alias("between"))


def between(keys: list[str], n: Column) -> Column:
    """Variance between the classes that each grey value of a histogram (keys, grey) parts, where n pixels have it."""
    up = Window.partitionBy(*keys).orderBy("grey").rangeBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    own = F.col("grey") * n
    n0, s0, n_all, s_all = F.sum(n).over(up), F.sum(own).over(up), F.sum(n).over(whole), F.sum(own).over(whole)
    apart = n_all * s0 - n0 * s_all
    return F.when(n0 < n_all, F.pow(apart.cast("double"), 2) / (n0 * (n_all - n0)).cast("double") / F.pow(n_all.cast("double"), 2)).otherwise(0.0)


def too_plain(black: Column) -> Column:
    """Whether a crop's share of black says that its local threshold failed, so that its own one is to be used."""
    return F.coalesce((black < LEAST_BLACK) | (black > MOST_BLACK), F.lit(True))


def judged(pixels: DataFrame, keys: list[str], grey: str = "grey", local: str = "ink") -> DataFrame:
    """keys, grey, n, ink, threshold: how many pixels have each value, how many of them local ink, and the crop's own threshold where that failed, else null.

    Windows run over counts, at most 257 rows a crop, so pixels are counted before they are dealt; no pixel is joined or sorted.
    """
    inked_, told = F.sum(F.when(F.col(local), 1).otherwise(0)).alias("ink"), F.count(local).alias("__told")
    counts = pixels.groupBy(*keys, F.col(grey).cast("int").alias("grey")).agg(F.count("*").alias("n"), inked_, told)
    whole, known = Window.partitionBy(*keys), F.when(F.col("grey").isNotNull(), F.col("n")).otherwise(0)
    black = F.sum("ink").over(whole) / F.nullif(F.sum("__told").over(whole), F.lit(0))
    own = counts.withColumn("__black", black).withColumn("__between", between(keys, known))
    top = F.max(F.when(F.col("grey").isNotNull(), F.struct(F.col("__between").alias("between"), (-F.col("grey")).alias("least")))).over(whole)
    own = own.withColumn("__top", top)
    failed = too_plain(F.col("__black")) & F.col("__top").isNotNull()
    return own.select(*keys, "grey", "n", "ink", F.when(failed, F.when(F.col("__top.between") > 0, -F.col("__top.least")).otherwise(0)).alias("threshold"))


def inked(pixels: DataFrame, keys: list[str], grey: str = "grey", local: str = "ink") -> DataFrame:
    """keys, pixels, inked: how many pixels a crop has, and how many of them are ink after ``binarised``."""
    ink = F.when(F.col("threshold").isNull(), F.col("ink")).when(F.col("grey") <= F.col("threshold"), F.col("n")).otherwise(0)
    return judged(pixels, keys, grey, local).groupBy(*keys).agg(F.sum("n").alias("pixels"), F.sum(ink).alias("inked"))


def binarised(pixels: DataFrame, keys: list[str], grey: str = "grey", local: str = "ink") -> DataFrame:
    """pixels (grey, and ink as a local threshold found it) with ink taken from the crop's own threshold where the local one failed."""
    own = judged(pixels, keys, grey, local).where("threshold is not null").groupBy(*keys).agg(F.first("threshold").alias("threshold"))
    both = pixels.join(own, keys, "left")
    return both.withColumn(local, F.when(F.col("threshold").isNull(), F.col(local)).otherwise(F.col(grey) <= F.col("threshold"))).drop("threshold")
