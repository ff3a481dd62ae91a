"""Missing fields from free text lines: labels by pattern, values by distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from idweave.functions.text import normalize_text, only_digits

LEFT_BONUS, DISTANCE_WEIGHT, RECOVERED = 0.15, 0.3, 0.85
LEAST_LIMIT, HEIGHTS = 45.0, 2.5


def shown_fields(norm: Column, patterns: list[tuple[str, str]]) -> Column:
    """Fields whose label a normalised text shows; each field's patterns are one literal expression, compiled once.

    Most lines are no label, which one expression of all patterns tells.
    """
    fields, none = dict.fromkeys(f for f, _ in patterns), F.array().cast("array<string>")
    one = {f: "|".join(f"(?:{p})" for g, p in patterns if g == f) for f in fields}
    shown = lambda: F.array_compact(F.array(*[F.when(norm.rlike(p), F.lit(f)) for f, p in one.items()]))
    return F.when(norm.rlike("|".join(one.values())), shown()).otherwise(none) if one else none


def label_lines(lines: DataFrame, patterns: list[tuple[str, str]], keys: list[str]) -> DataFrame:
    """keys, field and the surest line (line_no, cx, cy, h) whose normalised text shows the field's label.

    lines: keys, line_no, text, confidence, cx, cy, h. patterns: pairs of a field and an expression.
    """
    own = lines.withColumn("norm", normalize_text(F.col("text")))
    if patterns:
        own = own.where(F.col("norm").rlike("|".join(f"(?:{p})" for _, p in patterns)))  # few lines are labels
    hits = own.withColumn("field", F.explode(shown_fields(F.col("norm"), patterns)))
    top = F.max_by(F.struct("line_no", "cx", "cy", "h"), F.struct(F.col("confidence"), -F.col("line_no"))).alias("at")
    return hits.groupBy(*keys, "field").agg(top).select(*keys, "field", "at.*")


def value_pairs(labels: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """Every value line within a label's band, scored: confidence, less for distance, more to the label's left."""
    value = lines.select(*keys, F.col("line_no").alias("v_line"), "text", "confidence", F.col("cx").alias("v_cx"), F.col("cy").alias("v_cy"))
    limit = F.greatest(HEIGHTS * F.col("h"), F.lit(LEAST_LIMIT))
    dy = F.abs(F.col("v_cy") - F.col("cy"))
    near = labels.join(value, keys).withColumn("limit", limit).withColumn("dy", dy).where((F.col("v_line") != F.col("line_no")) & (F.col("dy") <= F.col("limit")))
    score = F.col("confidence") - DISTANCE_WEIGHT * F.col("dy") / F.col("limit") + F.when(F.col("v_cx") < F.col("cx"), LEFT_BONUS).otherwise(0.0)
    return near.withColumn("score", score)


def recovered(lines: DataFrame, patterns: list[tuple[str, str]], missing: DataFrame, keys: list[str]) -> DataFrame:
    """keys, field, text, confidence, label_found for fields of ``missing`` (keys, field).

    text is the best value beside the field's label, or null; label_found says whether there was a label. Lines that are
    any field's label are no values; dates need four digits, other fields hold two at most.
    """
    sought = missing.select(*keys, "field").distinct()
    labels = sought.join(label_lines(lines, patterns, keys), [*keys, "field"], "left")
    values = lines.where(F.size(shown_fields(normalize_text(F.col("text")), patterns)) == 0)
    pairs = value_pairs(labels.where("line_no is not null"), values, keys)
    digits = F.length(only_digits(F.col("text")))
    fits = F.when(F.col("field").endswith("_date"), digits >= 4).otherwise(digits <= 2) & (F.trim("text") != "")
    rank = F.row_number().over(Window.partitionBy(*keys, "field").orderBy(F.desc("score"), "v_line"))
    best = pairs.where(fits).withColumn("__place", rank).where("__place = 1")
    best = best.select(*keys, "field", F.trim("text").alias("text"), (F.col("confidence") * RECOVERED).alias("confidence"))
    return labels.select(*keys, "field", F.col("line_no").isNotNull().alias("label_found")).join(best, [*keys, "field"], "left").select(*keys, "field", "text", "confidence", "label_found")
