"""A card put together from the holes that its print leaves: greedy growth of boxes, one hole at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from idweave.functions.binding import bind
from idweave.functions.geometry import AREA_SHARES, CARD_RATIO, LEAST_MERGED_AREA, RATIO_TOLERANCE

# How many holes growth starts from and chooses among, how far apart they may lie, how large they grow.
SEEDS, POOL, GAP, MOST_SHARE = 4, 10, 0.30, 0.5


def box_aspect(w: Column, h: Column) -> Column:
    """1 at a card's ratio of sides, falling to 0 at the tolerance; 0 where a side is 1 or less."""
    off = F.abs(F.greatest(w, h) / F.least(w, h) - CARD_RATIO)
    return F.when((w <= 1) | (h <= 1), 0.0).when(off > RATIO_TOLERANCE, 0.0).otherwise(1 - off / RATIO_TOLERANCE)


def grown(pool: Column, seed: Column, frame: Column) -> Column:
    """Struct of a box grown from hole ``seed`` (a place in pool) by the hole that betters its aspect most, until none does.

    pool: array of structs x0, y0, x1, y1. A hole joins only if it lies near the box, and the box around both stays under half
    the frame's area; of equals the first joins. The state of the fold is the box, its aspect, and the holes in it.
    """

    def union(s: Column, c: Column) -> Column:
        return F.struct(F.least(s["x0"], c["x0"]).alias("x0"), F.least(s["y0"], c["y0"]).alias("y0"), F.greatest(s["x1"], c["x1"]).alias("x1"), F.greatest(s["y1"], c["y1"]).alias("y1"))

    def judged(s: Column, c: Column, i: Column) -> Column:
        gap = lambda a, b: F.greatest(F.lit(0.0), s[a] - c[b], c[a] - s[b])
        near = F.pow(gap("x0", "x1"), 2) + F.pow(gap("y0", "y1"), 2) <= GAP * GAP * frame
        made = lambda u: bind(F.struct((u["x1"] - u["x0"]).alias("w"), (u["y1"] - u["y0"]).alias("h")), lambda d: F.when(d["w"] * d["h"] <= MOST_SHARE * frame, F.struct(box_aspect(d["w"], d["h"]).alias("aspect"), (-i).alias("i"), u.alias("box"))))
        return F.when(near & ~F.array_contains(s["holes"], i), bind(union(s, c), made))

    def step(s: Column, _: Column) -> Column:
        best = F.array_max(F.filter(F.transform(pool, lambda c, i: judged(s, c, i)), lambda j: j["aspect"] > s["aspect"]))
        more = lambda j: F.struct(*[j["box"][c].alias(c) for c in ("x0", "y0", "x1", "y1")], j["aspect"].alias("aspect"), F.concat(s["holes"], F.array(-j["i"])).alias("holes"), F.lit(False).alias("done"))
        ended = F.struct(*[s[c].alias(c) for c in ("x0", "y0", "x1", "y1", "aspect", "holes")], F.lit(True).alias("done"))
        return F.when(s["done"], s).otherwise(bind(best, lambda j: F.when(j.isNull(), ended).otherwise(more(j))))

    own = F.get(pool, seed)
    start = F.struct(*[own[c].alias(c) for c in ("x0", "y0", "x1", "y1")], box_aspect(own["x1"] - own["x0"], own["y1"] - own["y0"]).alias("aspect"), F.array(seed).alias("holes"), F.lit(False).alias("done"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(POOL)), start, step)


def hole_candidates(holes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, seed, x0, y0, x1, y1, aspect, merges, area_share of the boxes that holes (x0, y0, x1, y1, frame: its area) grow to.

    The largest holes of a fit area are each tried as a beginning; boxes that nothing joined, without any aspect or of too
    little area are no candidates. Holes are taken by their boxes. Only the ten largest of a capture are gathered.
    """
    low, high = AREA_SHARES["holes"]
    size = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    fit = holes.withColumn("size", size.cast("double")).where((F.col("size") >= low * F.col("frame")) & (F.col("size") <= high * F.col("frame")))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("size"), "x0", "y0", "x1", "y1"))
    top = fit.withColumn("place", place).where(F.col("place") <= POOL)
    box = F.struct("place", *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")])
    pool = top.groupBy(*keys).agg(F.array_sort(F.collect_list(box)).alias("pool"), F.first("frame").cast("double").alias("frame"))
    seeds = pool.where(F.size("pool") >= 2).withColumn("seed", F.explode(F.sequence(F.lit(0), F.least(F.size("pool"), F.lit(SEEDS)) - 1)))
    made = seeds.withColumn("g", grown(F.col("pool"), F.col("seed"), F.col("frame")))
    share = (F.col("g.x1") - F.col("g.x0")) * (F.col("g.y1") - F.col("g.y0")) / F.col("frame")
    out = made.select(*keys, "seed", "g.x0", "g.y0", "g.x1", "g.y1", "g.aspect", (F.size("g.holes") - 1).alias("merges"), share.alias("area_share"))
    return out.where((F.col("aspect") > 0) & (F.col("merges") > 0) & (F.col("area_share") >= LEAST_MERGED_AREA))
