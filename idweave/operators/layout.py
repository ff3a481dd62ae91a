"""The card's regions and field labels as a small table, and the patterns that show a label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from idweave.functions.binding import bind
from idweave.functions.geometry import region_box
from idweave.operators.sizes import small

# Field, kind, x1, y1, x2, y2 as shares of the card, label.
REGIONS = [
    ("national_id", "number", 0.367, 0.236, 0.822, 0.337, "National ID"),
    ("first_name", "text", 0.369, 0.343, 0.823, 0.442, "First Name"),
    ("last_name", "text", 0.370, 0.447, 0.824, 0.546, "Last Name"),
    ("birth_date", "date", 0.371, 0.552, 0.825, 0.650, "Birth Date"),
    ("father_name", "text", 0.371, 0.654, 0.826, 0.739, "Father's Name"),
    ("expiry_date", "date", 0.371, 0.745, 0.827, 0.829, "Expiry Date"),
    ("photo", "photo", 0.055, 0.199, 0.357, 0.759, "Photo"),
]
# Field, pattern searched in normalised text.
LABEL_PATTERNS = [
    ("national_id", r"شماره\s*ملی"),
    ("national_id", r"کد\s*ملی"),
    ("first_name", r"^نام$"),
    ("last_name", r"نام\s*خانوادگی"),
    ("last_name", r"خانوادگی"),
    ("father_name", r"نام\s*پدر"),
    ("father_name", r"^پدر$"),
    ("birth_date", r"تاریخ\s*تولد"),
    ("birth_date", r"تولد"),
    ("expiry_date", r"پایان\s*اعتبار"),
    ("expiry_date", r"تاریخ\s*انقضا"),
    ("expiry_date", r"اعتبار"),
    ("expiry_date", r"انقضا"),
]
REQUIRED = ["national_id", "first_name", "last_name", "father_name", "birth_date", "expiry_date"]


def regions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REGIONS, "field string, kind string, x1 double, y1 double, x2 double, y2 double, label string")


def calibrated(boxes: DataFrame) -> DataFrame:
    """Regions from dragged corners (field, ax, ay, bx, by, width, height): ordered shares to three decimals."""
    share = lambda f, a, b, size: F.round(f(a, b) / F.col(size), 3)
    return boxes.select(
        "field",
        share(F.least, "ax", "bx", "width").alias("x1"),
        share(F.least, "ay", "by", "height").alias("y1"),
        share(F.greatest, "ax", "bx", "width").alias("x2"),
        share(F.greatest, "ay", "by", "height").alias("y2"),
    )


def exploded(cards: DataFrame, layout: DataFrame) -> DataFrame:
    """A row for each card (width, height, any other columns) and text region, with the padded box in pixels."""
    own = small(layout.where("kind <> 'photo'").select("field", "kind", "x1", "y1", "x2", "y2"))
    box = region_box(*[F.col(c) for c in ("x1", "y1", "x2", "y2", "width", "height")])
    return cards.crossJoin(own).withColumn("box", box).drop("x1", "y1", "x2", "y2")


#: Versions that are looked through at once; a key's versions are dealt into parts of so many.
PART = 64


def last_at(times: Column, at: Column) -> Column:
    """Place of the last of sorted times that is not after ``at``, from 1; 0 if all are. By halving: a step for each bit of their number."""
    powers = F.slice(F.array(*[F.lit(1 << k) for k in range(30, -1, -1)]), 32 - F.length(F.bin(F.size(times))), F.lit(31))
    return F.aggregate(powers, F.lit(0), lambda n, step: F.when(F.get(times, n + step - 1) <= at, n + step).otherwise(n))


def layout_as_of(captures: DataFrame, versions: DataFrame, keys: list[str], at: str = "taken_at", since: str = "valid_from") -> DataFrame:
    """captures with version: the columns of the layout that was valid when each was taken, as a struct; null before the first.

    versions: keys, since, version_no and any other columns. Of versions valid from the same time the one of the largest
    version_no counts, and a capture taken at that very time has it already. Versions are dealt by key, in order, into parts of
    ``PART``; each capture finds its part among the times that parts begin with, then its version in the part, by halving both
    times. So captures are neither sorted nor gathered, however many one key has, and none carries more than a part along; a null
    time or key has no version.
    """
    facts = [c for c in versions.columns if c not in (*keys, since, "version_no")]
    one = F.max_by(F.struct(*facts), "version_no").alias("facts") if facts else F.lit(None).cast("string").alias("facts")
    latest = versions.where(F.col(since).isNotNull()).groupBy(*keys, since).agg(F.max("version_no").alias("version_no"), one)
    entry = F.struct(F.col(since).alias("since"), "version_no", "facts")
    listed = latest.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("__versions"))
    dealt = F.transform(F.sequence(F.lit(1), F.size("__versions"), F.lit(PART)), lambda k: F.slice("__versions", k, F.lit(PART)))
    parts = listed.select(*keys, F.posexplode(dealt).alias("__part", "__versions"))
    parts = parts.select(*keys, (F.col("__part") + 1).alias("__part"), F.transform("__versions", lambda v: v["since"]).alias("__since"), "__versions")
    begun = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.get("__since", F.lit(0)))).alias("__begun"))
    both = captures.join(small(begun), keys, "left").withColumn("__part", last_at(F.col("__begun"), F.col(at))).drop("__begun")
    both = both.join(small(parts), [*keys, "__part"], "left")
    found = F.get("__versions", last_at(F.col("__since"), F.col(at)) - 1)
    wanted = bind(found, lambda v: F.when(v.isNotNull(), F.struct(v["since"].alias(since), v["version_no"].alias("version_no"), *[v["facts"][c].alias(c) for c in facts])))
    return both.select(*captures.columns, F.when(F.col("__versions").isNotNull(), wanted).alias("version"))
