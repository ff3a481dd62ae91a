"""Quality flags, the review flag, missing fields, the answer as JSON, and approved corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idweave.functions.binding import bind, named
from idweave.functions.codes import is_valid
from idweave.operators.layout import REGIONS, REQUIRED

BLURRY_UNDER, DARK_UNDER, BRIGHT_OVER, LEAST_SIDE, LEAST_CONFIDENCE = 80.0, 70.0, 210.0, 480, 0.35
#: Fixed value: the order in which missing fields are listed.
MISSING_ORDER = ["national_id", "first_name", "last_name", "father_name", "birth_date", "expiry_date"]
#: The order in which fields are read.
READ_ORDER = [r[0] for r in REGIONS if r[1] != "photo"]


def quality(width: Column, height: Column, blur: Column, brightness: Column) -> Column:
    """The quality struct; flags look at unrounded values."""
    return F.struct(
        width.cast("int").alias("width"),
        height.cast("int").alias("height"),
        F.round(blur, 2).alias("blur_score"),
        F.round(brightness, 2).alias("brightness"),
        (blur < BLURRY_UNDER).alias("is_blurry"),
        (brightness < DARK_UNDER).alias("is_dark"),
        (brightness > BRIGHT_OVER).alias("is_overexposed"),
        (F.least(width, height) >= LEAST_SIDE).alias("resolution_ok"),
    )


def issues(q: Column) -> Column:
    """Codes of a capture's issues, in order; any of them asks for a review."""
    found = [F.when(q["is_blurry"], F.lit("blurry")), F.when(~q["resolution_ok"], F.lit("low_resolution")), F.when(q["is_dark"], F.lit("dark")), F.when(q["is_overexposed"], F.lit("overexposed"))]
    return F.array_compact(F.array(*found))


def gate(q: Column, warnings: Column, flagged: Column) -> Column:
    """Struct warnings, needs_review: a capture's issues are one more warning and ask for a review whatever was read."""
    found = lambda i: F.struct(F.when(F.size(i) > 0, F.array_append(warnings, F.concat(F.lit("capture_quality:"), F.array_join(i, ",")))).otherwise(warnings).alias("warnings"), (flagged | (F.size(i) > 0)).alias("needs_review"))
    return bind(issues(q), found)


def is_missing(value: Column, confidence: Column) -> Column:
    return value.isNull() | (value == "") | (F.coalesce(confidence, F.lit(0.0)) < LEAST_CONFIDENCE)


def missing_fields(values: dict[str, Column]) -> Column:
    """Names of the fields without a value, text fields first, then dates."""
    return F.array_compact(F.array(*[F.when(F.coalesce(values[f], F.lit("")) == "", F.lit(f)) for f in MISSING_ORDER if f in values]))


def field_struct(f: str, part) -> Column:
    """A field's value in the record: text, or for dates a struct jalali, iso, raw, candidates."""
    if not f.endswith("_date"):
        return part(f, "value").alias(f)
    none = F.array().cast("array<string>")
    return F.struct(part(f, "value").alias("jalali"), part(f, "iso").alias("iso"), part(f, "raw").alias("raw"), F.coalesce(part(f, "candidates"), none).alias("candidates")).alias(f)


def record(fields: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each capture: data, confidence, validation, missing_fields, warnings, needs_review.

    fields: keys, field, value, confidence, and where known iso, raw, candidates, warnings (of the field's first reading)
    and more_warnings (of its recovery). Fields without a row are empty and have the confidence 0. Warnings are listed in
    the order of the stages, within a stage in the order of the regions or the required fields; ``check_digit`` comes last.
    """
    kinds = {"iso": "date", "raw": "string", "candidates": "array<string>", "warnings": "array<string>", "more_warnings": "array<string>"}
    own = fields.select("*", *[F.lit(None).cast(t).alias(c) for c, t in kinds.items() if c not in fields.columns])
    facts = F.struct("value", "confidence", *kinds)
    wide = own.groupBy(*keys).agg(*[F.first(F.when(F.col("field") == f, facts), ignorenulls=True).alias(f) for f in REQUIRED])
    return wide.select(*keys, *record_columns(lambda f, c: F.col(f)[c]))


def record_of(captures: DataFrame, keys: list[str]) -> DataFrame:
    """As ``record``, of captures whose fields are in one row already, without texts and warnings of the reading.

    captures: keys, for each required field a struct value, confidence or null. Nothing is dealt or gathered.
    """
    none = {"iso": "date", "raw": "string", "candidates": "array<string>", "warnings": "array<string>", "more_warnings": "array<string>"}
    return captures.select(*keys, *record_columns(lambda f, c: F.lit(None).cast(none[c]) if c in none else F.col(f)[c]))


def record_columns(part) -> list[Column]:
    """data, confidence, validation, missing_fields, warnings, needs_review from part(field, what), as ``record`` has it."""
    code = part("national_id", "value")
    valid, missing = named(is_valid(code)), named(missing_fields({f: part(f, "value") for f in REQUIRED}))
    listed = lambda c, order: F.concat(*[F.coalesce(part(f, c), F.array().cast("array<string>")) for f in order])
    last = F.when((F.length(code) == 10) & ~valid, F.array(F.lit("check_digit"))).otherwise(F.array().cast("array<string>"))
    confidence = F.create_map(*[x for f in REQUIRED for x in (F.lit(f), F.round(F.coalesce(part(f, "confidence"), F.lit(0.0)), 3))])
    return [
        F.struct(*[field_struct(f, part) for f in REQUIRED]).alias("data"),
        confidence.alias("confidence"),
        F.struct(valid.alias("national_id")).alias("validation"),
        missing.alias("missing_fields"),
        F.concat(listed("warnings", READ_ORDER), listed("more_warnings", REQUIRED), last).alias("warnings"),
        ((F.size(missing) > 0) | ~valid).alias("needs_review"),
    ]


def answers(records: DataFrame, keys: list[str]) -> DataFrame:
    """keys and the record as JSON."""
    return records.select(*keys, F.to_json(F.struct(*[c for c in records.columns if c not in keys])).alias("answer"))


def approved(extracted: DataFrame, corrections: DataFrame, keys: list[str], fields: list[str], at: str | None = None) -> DataFrame:
    """extracted with an operator's corrections in place of its fields, where there are any; marked as approved then.

    A key with several corrections has the latest by ``at``, or without it the largest; so no row is doubled.
    """
    order = F.struct(*([at] if at else []), *fields)
    own = corrections.groupBy(*keys).agg(F.max(order).alias("new")).select(*keys, *[F.col(f"new.{f}").alias(f"new_{f}") for f in fields], F.lit(True).alias("approved"))
    both = extracted.join(own, keys, "left")
    rest = [c for c in extracted.columns if c not in (*keys, *fields)]
    return both.select(*keys, *[F.coalesce(F.nullif(F.trim(f"new_{f}"), F.lit("")), F.col(f)).alias(f) for f in fields], *rest, F.coalesce("approved", F.lit(False)).alias("approved"))


def best_candidate(candidates: list[DataFrame], keys: list[str]) -> DataFrame:
    """The candidate (score, seq, quad) of the highest score from several detectors' tables.

    Earlier tables win ties, then the least seq, then the least corners, so that the choice does not depend on the order of rows.
    """
    from functools import reduce

    every = reduce(DataFrame.unionByName, [c.withColumn("detector", F.lit(k)) for k, c in enumerate(candidates)])
    top = F.min_by(F.struct("quad", "score", "detector"), F.struct(-F.col("score"), F.col("detector"), F.col("seq"), F.col("quad"))).alias("best")
    return every.where("score > 0").groupBy(*keys).agg(top).select(*keys, "best.*")
