"""Which tables are small enough to be sent to every executor, and how work that is more than its bytes is spread and compiled."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_ROWS = 10_000


def small(df: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """df, to be broadcast if it has ``most_rows`` rows at most; a larger one is joined however the optimizer sees fit."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def spread(df: DataFrame, key: str) -> DataFrame:
    """df dealt by its key to as many partitions as a shuffle has; by number, so that none are put together for having few bytes."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def compiled(spark: SparkSession) -> None:
    """From now on expressions that make a method of more than 8,000 bytes, which the JVM would interpret, are split into several."""
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
