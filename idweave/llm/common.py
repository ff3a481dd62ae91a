"""Helpers shared by the corpus operators: staged tables, Arrow batch sizes, table reading."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

ARROW_ROWS = 256
_noted: ContextVar[tuple[list[Staged], ...]] = ContextVar("noted", default=())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Whole texts cross to Python, so a batch holds few rows and stays a few MB."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one where that is unset and Spark runs on one machine, as in tests."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        own = context.getConf().get("spark.checkpoint.dir")
        if not own and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(own or tempfile.mkdtemp(prefix="idweave-"))
    return context.getCheckpointDir()


class Staged:
    """A table written to the shared folder, so that lost executors and retries never recompute what led to it.

    Those of a thread are entered in the lists that ``noting`` has open there.
    """

    def __init__(self, df: DataFrame, name: str, **options: str):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/staged/{name}-{uuid.uuid4().hex}"
        schema = df.schema
        df.write.options(**options).parquet(self.path)
        self.df = self.spark.read.schema(schema).parquet(self.path)
        for own in _noted.get():
            own.append(self)

    def drop(self) -> None:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


@contextmanager
def noting() -> Iterator[list[Staged]]:
    """A list of the tables staged inside, for whoever can tell when they are no longer read."""
    own: list[Staged] = []
    before = _noted.set((*_noted.get(), own))
    try:
        yield own
    finally:
        _noted.reset(before)


def decided(make: Callable[[], DataFrame], name: str, **options: str) -> DataFrame:
    """What make() returns, as a written table; all that was staged on the way to it is dropped."""
    with noting() as used:
        out = Staged(make(), name, **options)
    for table_ in used:
        if table_ is not out:
            table_.drop()
    return out.df


def staged(df: DataFrame, name: str) -> DataFrame:
    return Staged(df, name).df


def class_sample(df: DataFrame, cls: str, text: str, per_class: int) -> DataFrame:
    """At most ``per_class`` different non-null texts of each non-null class, those of least hash: columns cls, text."""
    rows = df.select(F.col(cls).alias("cls"), F.col(text).alias("text"), F.xxhash64(text).alias("h")).where("cls is not null and text is not null")
    least = Window.partitionBy("cls").orderBy("h")
    chosen = rows.select("cls", "h").distinct().withColumn("k", F.row_number().over(least)).where(F.col("k") <= per_class)
    return rows.join(F.broadcast(chosen), ["cls", "h"]).dropDuplicates(["cls", "h"]).select("cls", "k", "text")


def map_text(df: DataFrame, text: str, extra: T.StructType, make) -> DataFrame:
    """df with the columns of ``extra`` that make(list of texts) returns as lists; columns of those names are replaced."""
    df = df.drop(*extra.names)
    schema = T.StructType([*df.schema.fields, *extra.fields])
    at, arrow = df.columns.index(text), to_arrow_schema(extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = make(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(v, f.type) for v, f in zip(made, arrow))], [*batch.schema.names, *arrow.names])

    return df.mapInArrow(run, schema)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges`` (src, dst: long): columns node, component (the component's least node).

    Distributed union-find by contraction: in every round each node hooks onto the node of least hash within two steps,
    and edges are rewritten between the hooks until none are left. A star is one node after a round; hashes are dealt
    anew each round, so the number of rounds grows with the logarithm of the longest chain. Nodes are traced to their
    roots from the last round back, so every round's nodes are joined once. Each round is a written table, so a lost
    executor costs at most the round under way; they are dropped at the end. Nodes without edges are not returned.
    """
    one = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).where("src is not null and dst is not null and src <> dst")
    with noting() as used:
        left, hooks = Staged(one.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), "edges").df, []
        while not left.isEmpty():
            salt = F.lit(len(hooks))
            both = left.unionByName(left.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
            rank = lambda c: F.struct(F.xxhash64(c, salt).alias("h"), F.col(c).alias("n"))
            near = both.groupBy("src").agg(F.min(F.least(rank("src"), rank("dst"))).alias("least"))
            further = both.join(near.withColumnRenamed("src", "dst"), "dst").groupBy("src").agg(F.min("least").alias("least"))
            hook = Staged(further.select(F.col("src").alias("node"), F.col("least.n").alias("to")), "hooks").df
            hooks.append(hook)
            moved = left.join(hook.toDF("src", "a"), "src").join(hook.toDF("dst", "b"), "dst").where("a <> b")
            left = Staged(moved.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct(), "edges").df
        if not hooks:
            return edges.sparkSession.createDataFrame([], "node long, component long")
        roots = hooks[-1].withColumnRenamed("to", "root")
        for k, hook in enumerate(reversed(hooks[:-1])):
            roots = Staged(hook.join(roots.toDF("to", "root"), "to", "left").select("node", F.coalesce("root", "to").alias("root")), f"roots{k}").df
        least = roots.groupBy("root").agg(F.min("node").alias("component"))
        out = Staged(roots.join(least, "root").select("node", "component"), "components")
    for table_ in used:
        if table_ is not out:
            table_.drop()
    return out.df
