"""Quadrilaterals as arrays of four structs x, y, and boxes, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from idweave.functions.binding import bind

CARD_RATIO, RATIO_TOLERANCE = 1.586, 0.22


def xs(quad: Column) -> Column:
    return F.transform(quad, lambda p: p["x"])


def ys(quad: Column) -> Column:
    return F.transform(quad, lambda p: p["y"])


def ordered(quad: Column) -> Column:
    """Top left, top right, bottom right, bottom left: by least and largest x + y and y - x, the first of equals."""

    def pick(value, largest: bool) -> Column:
        keyed = F.transform(quad, lambda p, i: F.struct((-value(p) if largest else value(p)).alias("v"), i.alias("i"), p.alias("p")))
        return F.array_min(keyed)["p"]

    total, slope = lambda p: p["x"] + p["y"], lambda p: p["y"] - p["x"]
    return F.array(pick(total, False), pick(slope, False), pick(total, True), pick(slope, True))


def aspect_score(quad: Column) -> Column:
    """1 at a card's ratio of sides, falling to 0 at the tolerance; 0 where a side is 1 or less."""

    def score(s: Column) -> Column:
        off = F.abs(F.greatest(s["w"], s["h"]) / F.least(s["w"], s["h"]) - CARD_RATIO)
        return F.when((s["w"] <= 1) | (s["h"] <= 1) | (off > RATIO_TOLERANCE), 0.0).otherwise(1 - off / RATIO_TOLERANCE)

    def sides(p: Column) -> Column:
        far = lambda i, j: F.sqrt(F.pow(p[i]["x"] - p[j]["x"], 2) + F.pow(p[i]["y"] - p[j]["y"], 2))
        return bind(F.struct(((far(2, 3) + far(1, 0)) / 2).alias("w"), ((far(2, 1) + far(3, 0)) / 2).alias("h")), score)

    return bind(ordered(quad), sides)


def spans_frame(quad: Column, width: Column, height: Column, share: float = 0.88) -> Column:
    x, y = xs(quad), ys(quad)
    outside = (F.array_min(x) < -1) | (F.array_min(y) < -1) | (F.array_max(x) > width + 1) | (F.array_max(y) > height + 1)
    return outside | (((F.array_max(x) - F.array_min(x)) / width >= share) & ((F.array_max(y) - F.array_min(y)) / height >= share))


def touches_corner(quad: Column, width: Column, height: Column, margin: float = 3.0) -> Column:
    near = lambda v, size: (v <= margin) | (v >= size - 1 - margin)
    return F.exists(quad, lambda p: near(p["x"], width) & near(p["y"], height))


def touches_edge(quad: Column, width: Column, height: Column, margin: float = 6.0) -> Column:
    x, y = xs(quad), ys(quad)
    return (F.array_min(x) <= margin) | (F.array_min(y) <= margin) | (F.array_max(x) >= width - 1 - margin) | (F.array_max(y) >= height - 1 - margin)


def box_struct(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


def padded_box(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column, top: float = 0.55, bottom: float = 0.85, side: float = 0.35) -> Column:
    """A face's box with room around it, cut at the frame."""
    zero = F.lit(0)
    return box_struct(F.greatest(zero, (x - w * side).cast("int")), F.greatest(zero, (y - h * top).cast("int")), F.least(width, (x + w * (1 + side)).cast("int")), F.least(height, (y + h * (1 + bottom)).cast("int")))


def center_box(width: Column, height: Column, keep: float = 0.96) -> Column:
    """The largest card-shaped box in the middle of a frame, less a margin."""
    wide = width / height >= CARD_RATIO
    part = 1 - max(0.0, min(0.5, 1 - keep))
    w0 = F.when(wide, (height * CARD_RATIO).cast("int")).otherwise(width)
    h0 = F.when(wide, height).otherwise((width / CARD_RATIO).cast("int"))
    w, h = F.greatest(F.lit(20), (w0 * part).cast("int")), F.greatest(F.lit(20), (h0 * part).cast("int"))
    x, y = F.greatest(F.lit(0), F.floor((width - w) / 2).cast("int")), F.greatest(F.lit(0), F.floor((height - h) / 2).cast("int"))
    return box_struct(x, y, F.least(width, x + w), F.least(height, y + h))


def region_box(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column, pad_x: float = 0.02, pad_y: float = 0.10) -> Column:
    """A region given in shares of a card, in pixels, padded by a share of its own size and cut at the card."""
    px1, py1, px2, py2 = (x1 * width).cast("int"), (y1 * height).cast("int"), (x2 * width).cast("int"), (y2 * height).cast("int")
    ax, ay = F.greatest(F.lit(2), ((px2 - px1) * pad_x).cast("int")), F.greatest(F.lit(1), ((py2 - py1) * pad_y).cast("int"))
    return box_struct(F.greatest(F.lit(0), px1 - ax), F.greatest(F.lit(0), py1 - ay), F.least(width, px2 + ax), F.least(height, py2 + ay))


def box_metrics(quad: Column) -> Column:
    """Struct cx, cy, w, h of a polygon: the mean of its points, and the extent of its sides."""
    mean = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v)
    extent = lambda v: F.array_max(v) - F.array_min(v)
    return bind(F.struct(xs(quad).alias("x"), ys(quad).alias("y")), lambda s: F.struct(mean(s["x"]).alias("cx"), mean(s["y"]).alias("cy"), extent(s["x"]).alias("w"), extent(s["y"]).alias("h")))


def laid_long(quad: Column) -> Column:
    """Ordered corners, turned by one where the upright sides are longer, so that the first side is a long one."""
    far = lambda p, i, j: F.sqrt(F.pow(p[i]["x"] - p[j]["x"], 2) + F.pow(p[i]["y"] - p[j]["y"], 2))
    return bind(ordered(quad), lambda p: F.when(far(p, 3, 0) + far(p, 2, 1) > far(p, 1, 0) + far(p, 2, 3), F.array(p[3], p[0], p[1], p[2])).otherwise(p))


# Least and largest share of the frame that a candidate of each detector covers.
AREA_SHARES = {"edges": (0.025, 0.98), "texture": (0.025, 0.97), "color": (0.025, 0.97), "holes": (0.003, 0.35)}


def fits_area(area: Column, frame: Column, detector: Column) -> Column:
    """Whether a candidate's area is within its detector's shares of the frame; unknown detectors have none."""
    return F.coalesce(F.coalesce(*[F.when(detector == d, (area >= frame * low) & (area <= frame * high)) for d, (low, high) in AREA_SHARES.items()]), F.lit(False))


def largest_face(faces: Column, width: Column, height: Column) -> Column:
    """Struct box, face_detected, warning from an array of face boxes (x, y, w, h) in a frame: the largest, the first of equals.

    Without a face, or if its padded box is empty, the box is the whole frame.
    """
    whole = box_struct(F.lit(0), F.lit(0), width.cast("int"), height.cast("int"))
    made = lambda box, found, warning: F.struct(box.alias("box"), F.lit(found).alias("face_detected"), F.lit(warning).cast("string").alias("warning"))
    first = F.get(F.array_sort(F.transform(faces, lambda f, i: F.struct((-f["w"] * f["h"]).alias("a"), i.alias("i"), f.alias("f")))), F.lit(0))["f"]
    padded = lambda f: padded_box(f["x"], f["y"], f["w"], f["h"], width, height)
    valid = lambda b: F.when((b["x2"] > b["x1"]) & (b["y2"] > b["y1"]), made(b, True, None)).otherwise(made(whole, False, "photo_crop_invalid"))
    return F.when(F.coalesce(F.size(faces), F.lit(0)) <= 0, made(whole, False, "face_not_found")).otherwise(bind(first, lambda f: bind(padded(f), valid)))


def upside_down(flag: Column, flag_turned: Column, skin_left: Column, skin_right: Column, digits: Column, digits_turned: Column) -> Column:
    """Whether a card is to be turned around: by its flag, else by a clear gap of skin tone, else by how well digits read."""
    biggest = F.greatest(skin_left, skin_right)
    clear = (biggest > 0.03) & (F.abs(skin_left - skin_right) > 0.3 * biggest)
    return F.when((flag > 0) | (flag_turned > 0), flag_turned > flag).when(clear, skin_right > skin_left).otherwise(digits_turned > digits)


# What a side's gradient is measured against, shares of the weakest side and of all, and what a candidate's
# score is made of for each detector: aspect, edge, density.
FULL_EDGE, WEAKEST, EVERY_SIDE = 60.0, 0.55, 0.45
SCORE_PARTS = {"edges": (0.55, 0.45, 0.0), "texture": (0.35, 0.30, 0.35), "color": (0.5, 0.5, 0.0), "holes": (0.65, 0.35, 0.0)}
LEAST_DENSITY, LEAST_MERGED_AREA, MOST_SKIN, LEAST_TEXTURE = 0.05, 0.04, 0.4, 12.0


def edge_support(sides: Column) -> Column:
    """0 to 1 from the mean gradients along a quadrilateral's four sides: mostly the weakest one's."""
    scores = F.transform(sides, lambda m: F.least(F.lit(1.0), m / FULL_EDGE))
    return bind(scores, lambda s: WEAKEST * F.array_min(s) + EVERY_SIDE * F.aggregate(s, F.lit(0.0), lambda a, x: a + x) / 4)


def candidate_score(detector: Column, aspect: Column, edge: Column, density: Column, merges: Column, area: Column, skin: Column) -> Column:
    """A candidate's score by its detector's parts; null where the detector rejects it.

    All reject an aspect of 0; texture rejects what is nearly blank; holes reject what no merge made, what is small (area
    is a share of the frame) and what is mostly skin.
    """
    part = lambda k: F.coalesce(*[F.when(detector == d, F.lit(v[k])) for d, v in SCORE_PARTS.items()])
    lost = (aspect <= 0) | ((detector == "texture") & (density < LEAST_DENSITY)) | ((detector == "holes") & ((merges <= 0) | (area < LEAST_MERGED_AREA) | (skin > MOST_SKIN)))
    return F.when(~F.coalesce(lost, F.lit(True)), part(0) * aspect + part(1) * edge + part(2) * F.least(F.lit(1.0), 2.0 * density))


def is_flat(deviation: Column) -> Column:
    """Whether a warped card's grey values vary so little that it was not found; its frame's centre is used then."""
    return deviation < LEAST_TEXTURE
