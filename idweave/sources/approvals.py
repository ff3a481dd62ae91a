"""Corrections by operators, as JSON lines, and the table of approved records that they keep up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from idweave.operators.checkpoints import cut
from idweave.operators.layout import REQUIRED

BAD = "unread"
DATE = "struct<jalali: string>"
SCHEMA = ", ".join(["capture_id string", *[f"{f} {DATE if f.endswith('_date') else 'string'}" for f in REQUIRED], "photo_available boolean, validation struct<national_id: boolean>, review_required boolean, approved_at timestamp"])


def read_corrections(spark: SparkSession, path: str, schema: str = SCHEMA) -> tuple[DataFrame, DataFrame]:
    """Corrections of JSON files, one a line, and what could not be read as one: its text and its file.

    A line that is no JSON, does not fit the schema, or names no capture or time is set aside whole.
    """
    wanted = T.StructType.fromDDL(schema).add(BAD, T.StringType())
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).where(F.trim("value") != "")
    own = lines.withColumn("r", F.from_json("value", wanted, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}))
    sound = F.col(f"r.{BAD}").isNull() & F.col("r.capture_id").isNotNull() & F.col("r.approved_at").isNotNull()
    sound = F.coalesce(sound, F.lit(False))
    return own.where(sound).select("r.*").drop(BAD), own.where(~sound).select(F.col("value").alias("line"), "file")


def latest(corrections: DataFrame, keys: list[str], at: str = "approved_at") -> DataFrame:
    """The latest correction of each key; of several at one time the largest by its other columns, in their order."""
    rest = [c for c in corrections.columns if c not in (*keys, at)]
    top = F.max(F.struct(at, *rest)).alias("top")
    return corrections.groupBy(*keys).agg(top).select(*keys, "top.*").select(*corrections.columns)


def upsert(spark: SparkSession, target: str, corrections: DataFrame, keys: list[str], at: str = "approved_at", partition: str = "bucket", buckets: int = 64) -> list[int]:
    """Bring the table at ``target`` up to date with corrections, and return the partitions that were written.

    The table holds one row a key, its latest correction, in partitions by the keys' hash. Only partitions that a newer
    correction falls in are read and replaced; a second run with the same corrections, or older ones, writes nothing.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    new = cut(latest(corrections, keys, at).withColumn(partition, bucket))
    try:
        old = spark.read.parquet(target).select(*corrections.columns, F.col(partition).cast("int").alias(partition))
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        old = new.limit(0)
    rest = [c for c in corrections.columns if c not in (*keys, at)]
    rank = F.struct(at, *rest)
    known = old.select(*[F.col(k).alias(f"old_{k}") for k in keys], rank.alias("old_rank"))
    same = [F.col(k).eqNullSafe(F.col(f"old_{k}")) for k in keys]
    changed = cut(new.join(known, same, "left").where(F.col("old_rank").isNull() | (rank > F.col("old_rank"))).select(*new.columns))
    touched = [r[0] for r in changed.select(partition).distinct().collect()]  # ``buckets`` at most
    if touched:
        both = old.where(F.col(partition).isin(touched)).unionByName(changed)
        rows = cut(latest(both, [*keys, partition], at).select(*new.columns))
        rows.repartition(len(touched), partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(target)
    return sorted(touched)
