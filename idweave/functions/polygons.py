"""Contours as arrays of structs x, y: hulls, simplification, the four corners of a card, and its projective map."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from idweave.functions.binding import bind

POINTS = "array<struct<x: double, y: double>>"
# Tolerances as shares of a contour's length, for the contour and for its hull; least side of a warped card.
TIGHT, LOOSE, LEAST_SIDE = 0.02, 0.03, 20


def cross(o: Column, a: Column, b: Column) -> Column:
    return (a["x"] - o["x"]) * (b["y"] - o["y"]) - (a["y"] - o["y"]) * (b["x"] - o["x"])


def far(a: Column, b: Column) -> Column:
    return F.sqrt(F.pow(a["x"] - b["x"], 2) + F.pow(a["y"] - b["y"], 2))


def turned(points: Column, by: Column) -> Column:
    """points, beginning with the one at place ``by``."""
    return bind(by, lambda k: F.concat(F.slice(points, k + 1, F.size(points) - k), F.slice(points, F.lit(1), k)))


def around(points: Column, value) -> Column:
    """value(point, the next, the one after) for every point of a closed contour."""
    n = F.size(points)
    return F.transform(points, lambda p, i: value(p, F.get(points, (i + 1) % n), F.get(points, (i + 2) % n)))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def closed_length(points: Column) -> Column:
    return bind(points, lambda p: total(around(p, lambda a, b, _: far(a, b))))


def area(points: Column) -> Column:
    """The area within a closed contour that does not cross itself."""
    return bind(points, lambda p: F.abs(total(around(p, lambda a, b, _: a["x"] * b["y"] - b["x"] * a["y"]))) / 2)


def hull(points: Column) -> Column:
    """Corners of the convex hull, from the least point on, by a monotone chain; without points that lie on its sides."""

    def chain(own: Column) -> Column:
        def added(s: Column, p: Column) -> Column:
            turn = F.filter(F.sequence(F.lit(2), F.greatest(F.size(s), F.lit(2))), lambda k: (k <= F.size(s)) & (cross(F.get(s, k - 2), F.get(s, k - 1), p) > 0))
            return F.concat(F.slice(s, F.lit(1), F.coalesce(F.array_max(turn), F.least(F.size(s), F.lit(1)))), F.array(p))

        return F.aggregate(own, F.array().cast(POINTS), added)

    open_ = lambda s: F.slice(s, F.lit(1), F.size(s) - 1)
    both = lambda own: F.when(F.size(own) < 3, own).otherwise(F.concat(bind(chain(own), open_), bind(chain(F.reverse(own)), open_)))
    return bind(F.array_sort(F.array_distinct(points)), both)


def simplified(points: Column, tolerance: Column, most: int | None = None) -> Column:
    """A closed contour's points that Douglas and Peucker's rule keeps.

    Its arcs begin between the point farthest from the first and the one farthest from that; every arc with a point farther than
    the tolerance from the line between its ends is cut there, all arcs at once, until none is left. With ``most`` it ends as
    soon as more points than that are kept, which only become more.
    """

    def farthest(p: Column) -> Column:
        return -F.array_max(F.transform(p, lambda q, i: F.struct(far(F.get(p, F.lit(0)), q).alias("d"), (-i).alias("i"))))["i"]

    def split(p: Column, i: Column, j: Column) -> Column:
        def cut_at(e: Column) -> Column:
            off = F.transform(F.slice(p, i + 2, j - i - 1), lambda q, k: F.struct(F.abs(e["dx"] * (q["y"] - e["y"]) - e["dy"] * (q["x"] - e["x"])).alias("d"), (-k).alias("k")))
            return bind(F.array_max(off), lambda m: F.when(F.pow(m["d"], 2) > F.pow(tolerance, 2) * F.pow(e["far"], 2), F.array(i, i + 1 - m["k"])).otherwise(F.array(i)))

        ends = bind(F.struct(F.get(p, i).alias("a"), F.get(p, j % F.size(p)).alias("b")), lambda s: F.struct(s["a"]["x"].alias("x"), s["a"]["y"].alias("y"), (s["b"]["x"] - s["a"]["x"]).alias("dx"), (s["b"]["y"] - s["a"]["y"]).alias("dy"), far(s["a"], s["b"]).alias("far")))
        cut = bind(ends, cut_at)
        return F.when(j - i > 1, cut).otherwise(F.array(i))

    def arcs(p: Column) -> Column:
        def once(s: Column, _: Column) -> Column:
            kept = s["kept"]
            more = F.concat(F.flatten(F.transform(F.sequence(F.lit(1), F.size(kept) - 1), lambda k: split(p, F.get(kept, k - 1), F.get(kept, k)))), F.array(F.size(p)))
            enough = lambda m: F.lit(False) if most is None else F.size(m) > most + 1
            return F.when(s["done"], s).otherwise(bind(more, lambda m: F.struct(m.alias("kept"), ((F.size(m) == F.size(kept)) | enough(m)).alias("done"))))

        start = F.struct(F.array(F.lit(0), farthest(p), F.size(p)).alias("kept"), F.lit(False).alias("done"))
        kept = F.aggregate(F.sequence(F.lit(1), F.size(p)), start, once, lambda s: s["kept"])
        return bind(kept, lambda k: F.transform(F.slice(k, F.lit(1), F.size(k) - 1), lambda i: F.get(p, i)))

    wide = lambda p: F.when(F.size(p) < 3, p).otherwise(bind(turned(p, farthest(p)), arcs))
    return bind(points, wide)


def is_convex(points: Column) -> Column:
    return bind(around(points, cross), lambda c: ~(F.exists(c, lambda v: v > 0) & F.exists(c, lambda v: v < 0)))


def four_corners(points: Column, corners: Column | None = None) -> Column:
    """A contour reduced to a convex polygon of four points, itself or else its hull, more loosely; null if neither has four.

    ``corners`` is the contour's hull, for callers that have it already.
    """
    four = lambda p: F.when((F.size(p) == 4) & is_convex(p), p)
    # what has fewer points than four ends with fewer
    reduced = lambda p, tolerance: bind(p, lambda q: F.when(F.size(q) > 3, simplified(q, tolerance, 4)).otherwise(q))
    loose = lambda p, length: bind(reduced(hull(p) if corners is None else corners.cast(POINTS), length * LOOSE), four)
    own = lambda p, length: bind(reduced(p, length * TIGHT), lambda s: F.when(F.size(s) == 4, four(s)).otherwise(loose(p, length)))
    return bind(F.struct(points.cast(POINTS).alias("p"), closed_length(points.cast(POINTS)).alias("n")), lambda s: F.when(s["n"] > 0, own(s["p"], s["n"])))


def natural_size(quad: Column) -> Column:
    """Struct width, height of ordered corners: the longer one of opposite sides, in whole pixels; null where one is under 20."""
    whole = lambda i, j: F.floor(far(quad[i], quad[j])).cast("int")
    width, height = F.greatest(whole(2, 3), whole(1, 0)), F.greatest(whole(2, 1), whole(3, 0))
    return F.get(F.array(F.struct(width.alias("width"), height.alias("height"))), F.when((width >= LEAST_SIDE) & (height >= LEAST_SIDE), 0))


def projective(quad: Column, width: Column, height: Column) -> Column:
    """The map of ordered corners onto the corners of a box, as an array of nine numbers, row by row; null if the corners are on a line.

    The map of the unit square onto the corners is known in closed form; its adjugate leads back, and is scaled to the box. All is
    plain arithmetic without conditions, of which Spark computes equal parts once.
    """
    x, y = [quad[k]["x"] for k in range(4)], [quad[k]["y"] for k in range(4)]
    dx1, dx2, dy1, dy2 = x[1] - x[2], x[3] - x[2], y[1] - y[2], y[3] - y[2]
    sx, sy = x[0] - x[1] + x[2] - x[3], y[0] - y[1] + y[2] - y[3]
    den = dx1 * dy2 - dx2 * dy1
    g, h = ((part / F.nullif(den, F.lit(0.0))) for part in (sx * dy2 - dx2 * sy, dx1 * sy - sx * dy1))
    a, b, c, d, e, f = x[1] - x[0] + g * x[1], x[3] - x[0] + h * x[3], x[0], y[1] - y[0] + g * y[1], y[3] - y[0] + h * y[3], y[0]
    u, v = (e - f * h, c * h - b, b * f - c * e), (f * g - d, a - c * g, c * d - a * f)
    matrix = F.array(*[p * (width - 1) for p in u], *[p * (height - 1) for p in v], d * h - e * g, b * g - a * h, a * e - b * d)
    return F.get(F.array(matrix), F.when(den != 0, 0))


def mapped(matrix: Column, x: Column, y: Column) -> Column:
    """Struct x, y of a point under a projective map; null where it maps to infinity."""
    row = lambda k: matrix[3 * k] * x + matrix[3 * k + 1] * y + matrix[3 * k + 2]
    return F.when(row(2) != 0, F.struct((row(0) / row(2)).alias("x"), (row(1) / row(2)).alias("y")))
