"""Blobs of ink: runs of neighbouring rows that touch, joined into components, with boxes, areas and ink by column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idweave.operators.checkpoints import cut


def ink_runs(bits: Column, width: Column | int) -> Column:
    """Runs of ink in the rows of a crop (bits: array of boolean, row by row) as structs y, x0, x1 (exclusive), in reading order."""
    width = F.lit(width) if isinstance(width, int) else width
    places = F.when(F.size(bits) > 0, F.sequence(F.lit(0), F.size(bits) - 1)).otherwise(F.array().cast("array<int>"))
    ink = lambda i: F.coalesce(F.get(bits, i), F.lit(False))
    first = F.filter(places, lambda i: ink(i) & ((i % width == 0) | ~ink(i - 1)))
    last = F.filter(places, lambda i: ink(i) & ((i % width == width - 1) | ~ink(i + 1)))
    return F.zip_with(first, last, lambda a, b: F.struct(F.floor(a / width).cast("int").alias("y"), (a % width).cast("int").alias("x0"), (b % width + 1).cast("int").alias("x1")))


def components(edges: DataFrame, keys: list[str]) -> DataFrame:
    """keys, node, component of the nodes of undirected edges (keys, a, b: numbers within a key): the component's least node.

    In each round a node hooks onto the one of least hash within two steps, and edges move between the hooks until none is
    left; hashes are dealt anew each round, so the rounds grow with the logarithm of the longest chain. Each round is
    checkpointed. Nodes without edges are not returned.
    """
    left = cut(edges.where("a <> b").select(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    hooks: list[DataFrame] = []
    while not left.isEmpty():
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(len(hooks))).alias("h"), F.col(c).alias("n"))
        both = left.unionByName(left.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy(*keys, "a").agg(F.min(F.least(rank("a"), rank("b"))).alias("least"))
        further = both.join(near.withColumnRenamed("a", "b"), [*keys, "b"]).groupBy(*keys, "a").agg(F.min("least").alias("least"))
        hook = cut(further.select(*keys, F.col("a").alias("node"), F.col("least.n").alias("to")))
        hooks.append(hook)
        end = lambda c: hook.select(*keys, F.col("node").alias(c), F.col("to").alias(f"to_{c}"))
        moved = left.join(end("a"), [*keys, "a"]).join(end("b"), [*keys, "b"]).where("to_a <> to_b")
        left = cut(moved.select(*keys, F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct())
    if not hooks:
        return left.select(*keys, F.col("a").alias("node"), F.col("b").alias("component"))
    root = hooks[-1].withColumnRenamed("to", "root")
    for hook in reversed(hooks[:-1]):
        root = hook.join(root.withColumnRenamed("node", "to"), [*keys, "to"], "left").select(*keys, "node", F.coalesce("root", "to").alias("root"))
    least = root.groupBy(*keys, "root").agg(F.min("node").alias("component"))
    return root.join(least, [*keys, "root"]).select(*keys, "node", "component")


def blobs(runs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, blob, x, y, w, h, area, runs, columns of runs of ink (keys, run, y, x0, x1; run: a number within the crop).

    Runs of neighbouring rows belong together where they share a column or touch at a corner. blob is the least number of
    the blob's runs; columns is the ink of each of its columns, as ``split_wide`` reads it.
    """
    below = runs.select(*keys, F.col("run").alias("b"), (F.col("y") - 1).alias("y"), F.col("x0").alias("b0"), F.col("x1").alias("b1"))
    edges = runs.join(below, [*keys, "y"]).where("x0 <= b1 and b0 <= x1").select(*keys, F.col("run").alias("a"), "b")
    of = components(edges, keys).withColumnRenamed("node", "run")
    own = runs.join(of, [*keys, "run"], "left").withColumn("blob", F.coalesce("component", "run"))
    sums = own.groupBy(*keys, "blob").agg(
        F.min("x0").alias("x"), F.min("y").alias("y"), F.max("x1").alias("right"), F.max("y").alias("bottom"), F.sum(F.col("x1") - F.col("x0")).alias("area"), F.count("*").alias("runs"), F.collect_list(F.struct("x0", "x1")).alias("all_")
    )
    ink = F.transform(F.sequence(F.col("x"), F.col("right") - 1), lambda c: F.size(F.filter("all_", lambda r: (r["x0"] <= c) & (c < r["x1"]))))
    return sums.select(*keys, "blob", "x", "y", (F.col("right") - F.col("x")).alias("w"), (F.col("bottom") + 1 - F.col("y")).alias("h"), "area", "runs", ink.alias("columns"))
