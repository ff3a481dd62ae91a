"""Uploaded captures: reading, checking, and the ones turned away with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values.
EXTENSIONS = (".jpg", ".jpeg", ".png", ".webp")
MOST_BYTES = 10 * 1024 * 1024
SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """Frames that land in a folder, as a stream."""
    return spark.readStream.format("binaryFile").schema(SCHEMA).load(path)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def reject_reason(path: Column, length: Column) -> Column:
    """Why a file is turned away, or null."""
    ext = extension(path)
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return (
        F.when(F.coalesce(name, F.lit("")) == "", "no_name").when(~ext.isin(*EXTENSIONS), "extension").when(length > MOST_BYTES, "too_large").when(length == 0, "empty")
    )


def checked(captures: DataFrame) -> DataFrame:
    """captures with reason (null where accepted); the size filter reaches the scan."""
    return captures.withColumn("reason", reject_reason(F.col("path"), F.col("length")))


def accepted(captures: DataFrame) -> DataFrame:
    return captures.where((F.col("length") > 0) & (F.col("length") <= MOST_BYTES)).where(reject_reason(F.col("path"), F.col("length")).isNull())


def undecodable(spark: SparkSession, captures: DataFrame, path: str) -> DataFrame:
    """Accepted captures that the image reader cannot decode."""
    plain = lambda c: F.regexp_replace(c, r"^(\w+):/+", "$1:/")  # noqa: E731  the two readers write local paths differently
    images = spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true").load(path).select(plain("image.origin").alias("origin"))
    return accepted(captures).join(images, plain("path") == F.col("origin"), "left_anti")
