"""Blobs, holes, contours, maps, thresholds, confusion tables, layouts, engines and approvals against brute force and edge cases."""

import datetime as dt
import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from idweave import record_queries
from idweave.functions import codes, confusions, jalali, polygons, text
from idweave.functions.binding import with_bound
from idweave.operators import blobs, engines, holes, layout, review, thresholds
from idweave.plans import cards
from idweave.sources import approvals


def flood(image):
    """Components of eight neighbours, by flooding: box, area."""
    left, out = {(y, x) for y, row in enumerate(image) for x, b in enumerate(row) if b}, []
    while left:
        stack, own = [left.pop()], []
        while stack:
            y, x = stack.pop()
            own.append((y, x))
            for near in itertools.product((y - 1, y, y + 1), (x - 1, x, x + 1)):
                if near in left:
                    left.remove(near)
                    stack.append(near)
        ys, xs = [y for y, _ in own], [x for _, x in own]
        out.append((min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1, len(own), tuple(sum(x == c for x in xs) for c in range(min(xs), max(xs) + 1))))
    return sorted(out)


def test_blobs_equal_flooding(spark):
    rng = random.Random(5)
    images = [[[rng.random() < p for _ in range(17)] for _ in range(11)] for p in (0.0, 0.1, 0.35, 0.5, 0.8, 1.0)]
    spiral = [[(y + x) % 2 == 0 or y == 5 for x in range(17)] for y in range(11)]
    images += [spiral, [[x == 8 for x in range(17)] for y in range(11)]]
    df = spark.createDataFrame([(k, [b for row in image for b in row]) for k, image in enumerate(images)] + [(98, []), (99, None)], "crop int, bits array<boolean>")
    runs = df.select("crop", F.posexplode(blobs.ink_runs(F.col("bits"), 17)).alias("run", "r")).select("crop", "run", "r.*")
    got = {}
    for r in blobs.blobs(runs, ["crop"]).collect():
        got.setdefault(r["crop"], []).append((r["x"], r["y"], r["w"], r["h"], r["area"], tuple(r["columns"])))
    assert {k: sorted(v) for k, v in got.items()} == {k: f for k, f in ((k, flood(i)) for k, i in enumerate(images)) if f}


def test_hull_and_corners(spark):
    rng = random.Random(8)
    sets = [[(float(rng.randrange(12)), float(rng.randrange(9))) for _ in range(n)] for n in (1, 2, 3, 4, 7, 15, 30, 30)]
    sets += [[(1.0, 1.0)] * 3, [(0.0, 0.0), (1.0, 1.0), (2.0, 2.0)], []]

    def turn(o, a, b):
        return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])

    def corners(points):
        own = set(points)
        if len(own) < 3:
            return own
        return {p for p in own if any(all(turn(p, q, r) >= 0 and (turn(p, q, r) > 0 or (r[0] - p[0]) * (q[0] - p[0]) + (r[1] - p[1]) * (q[1] - p[1]) > 0) for r in own - {p}) for q in own - {p})}

    df = spark.createDataFrame([(k, [{"x": x, "y": y} for x, y in s]) for k, s in enumerate(sets)], f"k int, p {polygons.POINTS}")
    for r in df.select("k", polygons.hull(F.col("p")).alias("h"), polygons.four_corners(F.col("p")).alias("c")).collect():
        assert {(p["x"], p["y"]) for p in r["h"]} == corners(sets[r["k"]]), r["k"]
        assert r["c"] is None or len(r["c"]) == 4
    # a card with cut corners and a dent has four corners by its hull; one with rounded sides by itself
    card = [(10, 10), (60, 9), (110, 10), (110, 40), (109, 70), (60, 71), (11, 70), (10, 69)]
    dent = [(0, 0), (50, 0), (50, 20), (60, 20), (60, 0), (100, 0), (100, 60), (0, 60)]
    both = spark.createDataFrame([(k, [{"x": float(x), "y": float(y)} for x, y in s]) for k, s in enumerate((card, dent))], f"k int, p {polygons.POINTS}")
    found = {r["k"]: sorted((p["x"], p["y"]) for p in r["c"]) for r in both.select("k", polygons.four_corners(F.col("p")).alias("c")).collect()}
    assert found[1] == [(0, 0), (0, 60), (100, 0), (100, 60)] and len(found[0]) == 4


def test_corners_from_a_hull_that_is_there(spark):
    rng = random.Random(4)
    sets = [[(float(rng.randrange(40)), float(rng.randrange(30))) for _ in range(n)] for n in (1, 2, 3, 4, 4, 5, 6, 8, 8, 12, 20) for _ in range(6)]
    df = spark.createDataFrame([(k, [{"x": x, "y": y} for x, y in s]) for k, s in enumerate(sets)], f"k int, p {polygons.POINTS}")
    whole = df.withColumn("s", polygons.simplified(F.col("p"), F.lit(3.0))).withColumn("few", polygons.simplified(F.col("p"), F.lit(3.0), 4))
    for r in whole.select("*", polygons.four_corners(F.col("p")).alias("own"), polygons.four_corners(F.col("p"), polygons.hull(F.col("p"))).alias("given")).collect():
        assert r["own"] == r["given"]
        assert r["few"] == r["s"] if len(r["few"]) <= 4 else len(r["s"]) >= len(r["few"])


def test_projective_map(spark):
    quad = [(10.0, 12.0), (200.0, 30.0), (190.0, 150.0), (5.0, 120.0)]
    df = spark.createDataFrame([([{"x": x, "y": y} for x, y in quad],), ([{"x": float(k), "y": float(k)} for k in range(4)],), ([{"x": x / 20, "y": y / 20} for x, y in quad],)], f"q {polygons.POINTS}")
    made = df.select("q", polygons.natural_size(F.col("q")).alias("n"), polygons.projective(F.col("q"), F.lit(1100), F.lit(694)).alias("m")).collect()
    m = np.array(made[0]["m"]).reshape(3, 3)
    for (x, y), want in zip(quad, ((0, 0), (1099, 0), (1099, 693), (0, 693))):
        u, v, w = m @ (x, y, 1)
        assert np.allclose((u / w, v / w), want, atol=1e-6)
    assert made[1]["m"] is None and made[1]["n"] is None and made[2]["n"] is None  # on a line; too small
    assert tuple(made[0]["n"]) == (190, 120)


def test_projective_map_in_plain_arithmetic(spark):
    """No function over arrays, which Spark would interpret row by row; corners on a line, or a small box, still give null."""
    quads = [[(1.0, 2.0), (31.0, 4.0), (33.0, 30.0), (2.0, 28.0)], [(0.0, 0.0), (1.0, 1.0), (2.0, 2.0), (3.0, 3.0)]]
    df = spark.createDataFrame([([{"x": x, "y": y} for x, y in q],) for q in quads], f"q {polygons.POINTS}")
    made = df.select(polygons.projective(F.col("q"), F.lit(30), F.lit(25)).alias("m"), polygons.natural_size(F.col("q")).alias("n"), F.col("q")[2].alias("c"))
    assert "lambda" not in made._jdf.queryExecution().analyzed().toString()
    got = made.select("m", "n", polygons.mapped(F.col("m"), F.col("c.x"), F.col("c.y")).alias("t")).collect()
    assert got[0]["n"].asDict() == {"width": 31, "height": 26} and (round(got[0]["t"]["x"], 9), round(got[0]["t"]["y"], 9)) == (29.0, 24.0)
    assert got[1]["m"] is None and got[1]["n"] is None and got[1]["t"] is None


def test_inked_counts_equal_binarised_pixels(spark):
    rng = random.Random(4)
    rows = [(c, rng.choice([None, *range(0, 250, 50)]), rng.choice([True, False, None]) if c % 3 else c % 2 == 0) for c in range(12) for _ in range(40)] + [(20, None, True), (21, 7, None)]
    df = spark.createDataFrame(rows, "k int, grey int, ink boolean")
    want = thresholds.binarised(df, ["k"]).groupBy("k").agg(F.count("*").alias("pixels"), F.count(F.when(F.col("ink"), 1)).alias("inked"))
    made = thresholds.inked(df, ["k"])
    assert sorted(made.collect()) == sorted(want.collect())
    assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_thresholds(spark):
    rng = np.random.default_rng(4)
    crops = {1: np.concatenate([rng.integers(10, 60, 300), rng.integers(150, 240, 500)]), 2: np.full(40, 77), 3: rng.integers(0, 256, 2000), 4: np.array([0, 255])}

    def best(values):
        scores = []
        for t in range(256):
            a, b = values[values <= t], values[values > t]
            scores.append(len(a) * len(b) * (a.mean() - b.mean()) ** 2 if len(a) and len(b) else 0.0)
        return int(np.argmax(np.round(scores, 3))) if max(scores) > 0 else 0

    pixels = spark.createDataFrame([(k, int(v)) for k, own in crops.items() for v in own] + [(1, None)], "crop int, grey int")
    assert {r["crop"]: r["threshold"] for r in thresholds.thresholds(pixels, ["crop"]).collect()} == {k: best(v) for k, v in crops.items()}
    inked = thresholds.binarised(pixels.where("grey is not null").withColumn("ink", F.col("crop") != 1), ["crop"])
    assert {r["crop"]: r["n"] for r in inked.groupBy("crop").agg(F.sum(F.col("ink").cast("int")).alias("n")).collect()}[1] == 300


def grown_by_hand(boxes, frame):
    """Greedy growth, one hole at a time: seed, box, merges of what counts as a card."""
    pool = sorted((b for b in boxes if 0.003 * frame <= (b[2] - b[0]) * (b[3] - b[1]) <= 0.35 * frame), key=lambda b: (-(b[2] - b[0]) * (b[3] - b[1]), b))[:10]

    def aspect(b):
        w, h = b[2] - b[0], b[3] - b[1]
        off = abs(max(w, h) / min(w, h) - 1.586) if min(w, h) > 1 else 9
        return 0 if off > 0.22 else 1 - off / 0.22

    out = []
    for seed in range(min(4, len(pool)) if len(pool) > 1 else 0):
        box, held = pool[seed], {seed}
        while True:
            best = None
            for k, c in enumerate(pool):
                gap = max(0, box[0] - c[2], c[0] - box[2]) ** 2 + max(0, box[1] - c[3], c[1] - box[3]) ** 2
                both = (min(box[0], c[0]), min(box[1], c[1]), max(box[2], c[2]), max(box[3], c[3]))
                if k not in held and gap <= 0.09 * frame and (both[2] - both[0]) * (both[3] - both[1]) <= frame / 2 and aspect(both) > (best[0] if best else aspect(box)):
                    best = (aspect(both), k, both)
            if not best:
                break
            box, held = best[2], held | {best[1]}
        if aspect(box) > 0 and len(held) > 1 and (box[2] - box[0]) * (box[3] - box[1]) >= 0.04 * frame:
            out.append((seed, *box, len(held) - 1))
    return out


def test_holes(spark):
    rng = random.Random(2)
    sets = [[(x := float(rng.randrange(700)), y := float(rng.randrange(500)), x + rng.randrange(30, 260), y + rng.randrange(20, 160)) for _ in range(n)] for n in (0, 1, 2, 3, 6, 10, 25, 25, 25)]
    df = spark.createDataFrame([(k, *b, 700000.0) for k, own in enumerate(sets) for b in own], "capture int, x0 double, y0 double, x1 double, y1 double, frame double")
    got = {}
    for r in holes.hole_candidates(df, ["capture"]).collect():
        got.setdefault(r["capture"], []).append((r["seed"], r["x0"], r["y0"], r["x1"], r["y1"], r["merges"]))
    want = {k: grown_by_hand(own, 700000.0) for k, own in enumerate(sets)}
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v} and len(got) >= 3


def is_code(code):
    rest = sum(int(c) * (10 - k) for k, c in enumerate(code[:9])) % 11
    return len(set(code)) > 1 and int(code[9]) == (rest if rest < 2 else 11 - rest)


@pytest.mark.parametrize("pairs", [confusions.ZERO_FIVE, record_queries.PAIRS, {"1": "47", "4": "1", "7": "19"}, {}])
def test_repairs_equal_listing(spark, pairs):
    rng = random.Random(3)
    codes = ["".join(rng.choice("0123456789" if k % 2 else "015689") for _ in range(10)) for k in range(150)] + ["1111111114", "5555555550", "0555555555", "12345", "", None, "12345678٩0"]

    def listed(code):
        if not code or not code.isascii() or len(code) != 10 or is_code(code):
            return 0, None
        every = set()
        for v in itertools.product(*[[c, *pairs.get(c, "")] for c in code]):
            if 1 <= sum(a != b for a, b in zip(v, code)) <= 3 and is_code("".join(v)):
                every.add("".join(v))
        return len(every), min(every) if len(every) == 1 else None

    df = spark.createDataFrame([(c,) for c in codes], "code string")
    for r in df.select("code", confusions.repair_pairs(F.col("code"), pairs, most_places=10).alias("r")).collect():
        n, one = listed(r["code"])
        assert (r["r"]["repairs"], r["r"]["value"]) == (n, one if n == 1 else r["code"]), r
    if pairs == confusions.ZERO_FIVE:  # as the older repair of the same pair has it, but for codes that are valid themselves
        from idweave.functions import codes as older

        both = df.select("code", older.is_valid(F.col("code")).alias("valid"), older.repair_multi(F.col("code")).alias("old"), confusions.repair_pairs(F.col("code")).alias("new"))
        assert all(r["old"] == (r["new"]["value"] if r["new"]["class"] == "repaired" else None) for r in both.where("not valid").collect())


def test_repairs_without_tables_of_residues(spark):
    """Sums of changes only: no table of all residues is gone through for a code, and codes of nearly equal digits come out right."""
    codes = ["8888888888", "8888888881", "0000500000", "5555055550", "6668886660", "3838383838"]
    df = spark.createDataFrame([(c,) for c in codes], "code string").select("code", confusions.valid_repairs(F.col("code"), record_queries.PAIRS, 3).alias("r"))
    for r in df.collect():
        every = {"".join(v) for v in itertools.product(*[[c, *record_queries.PAIRS.get(c, "")] for c in r["code"]])}
        good = [v for v in every if 1 <= sum(a != b for a, b in zip(v, r["code"])) <= 3 and is_code(v)]
        assert tuple(r["r"]) == (len(good), sum(map(int, good)))
    assert "zip_with" not in df._jdf.queryExecution().analyzed().toString()


def test_layout_as_of(spark):
    day = lambda d: dt.date(2024, 1, d)
    versions = spark.createDataFrame([("a", day(5), 1, 0.1), ("a", day(9), 2, 0.2), ("a", day(9), 3, 0.3), ("b", None, 7, 0.7), (None, day(1), 8, 0.8)], "device string, valid_from date, version_no int, x1 double")
    shots = spark.createDataFrame([(1, "a", day(4)), (2, "a", day(5)), (3, "a", day(8)), (4, "a", day(9)), (5, "b", day(9)), (6, None, day(9)), (7, "a", None), (8, "c", day(9))], "k int, device string, taken_at date")
    got = {r["k"]: r["version"] and (r["version"]["version_no"], r["version"]["x1"]) for r in layout.layout_as_of(shots, versions, ["device"]).collect()}
    assert got == {1: None, 2: (1, 0.1), 3: (1, 0.1), 4: (3, 0.3), 5: None, 6: None, 7: None, 8: None}


def test_layout_among_many_versions(spark):
    """Versions of several parts: as many layouts as days, each found on its first and last day; no capture carries them all along."""
    days = lambda k: dt.date(2020, 1, 1) + dt.timedelta(days=3 * k)
    for n in (1, 2, layout.PART - 1, layout.PART, layout.PART + 1, 5 * layout.PART + 7):
        versions = spark.createDataFrame([("a", days(k), k) for k in range(n)], "device string, valid_from date, version_no int")
        shots = spark.createDataFrame([(3 * k + i, "a", days(k) + dt.timedelta(days=i)) for k in range(-1, n + 1) for i in range(3)], "k int, device string, taken_at date")
        own = layout.layout_as_of(shots, versions, ["device"])
        got = {r["k"]: r["version"] and r["version"]["version_no"] for r in own.collect()}
        assert got == {k: None if k < 0 else min(k // 3, n - 1) for k in range(-3, 3 * n + 3)}
    largest = own._jdf.queryExecution().optimizedPlan().toString()
    assert "__begun" in largest and "__part" in largest  # two lookups, in place of all of a key's versions


class Counting(record_queries.WrittenText):
    made = 0

    def __init__(self):
        type(self).made += 1


def test_engine_contract(spark):
    images = [b"0.5;0.5;12 3", None, b"", b"0.5;0.5;?", b"0.5;0.5;4", b"bad", b"0.9;0.1;\xd8\xb9\xd9\x84\xdb\x8c"]
    kinds = ["number"] * 6 + ["text"]
    raw, conf, error = engines.read_all(lambda: engines.the_engine(Counting), images, kinds)
    assert raw == ["123", None, None, None, "4", None, "علی"] and conf == [0.5, 0.0, 0.0, 0.0, 0.5, 0.0, 0.9]
    assert error == [None, "no_crop", "no_crop", "ValueError: unreadable", None, "IndexError: list index out of range", None] and Counting.made == 1
    assert list(engines.groups([b"xxx", b"yy", None, b"z" * 9, b"w"], ["a"] * 5, 5)) == [[0, 1], [3], [4]]
    crops = spark.createDataFrame([(k, i, t, "old") for k, (i, t) in enumerate(zip(images, kinds))], "capture_id int, image binary, kind string, raw string")
    got = engines.read_crops(crops, record_queries.WrittenText).orderBy("capture_id").collect()
    assert [r["raw"] for r in got] == raw and [r["error"] for r in got] == error
    with pytest.raises(ValueError):
        engines.read_all(lambda: type("Short", (), {"read": lambda self, i, k: []})(), [b"x"], ["text"])[2][0].index("no such error")


def test_engines_in_one_pass(spark):
    """Readings of engines side by side equal those of three joined tables, without a join; an engine is asked for its kinds only."""
    rows = [(1, "national_id", "number", "soft", b"0.8;0.7;0404796669"), (1, "national_id", "number", "binary", None), (1, "birth_date", "date", "soft", b"0.9;0.5;1380/05/12"), (1, "first_name", "text", "soft", b"0.2;0.1;?"),
            (1, "first_name", "text", "binary", "0.75;0.1;علی".encode()), (2, "national_id", "number", "soft", b""), (2, "birth_date", "date", "soft", b"0.9;0.5;13999999"), (2, "first_name", "text", "soft", "0.9;0.1;حسن".encode())]
    crops = spark.createDataFrame(rows, "capture_id long, field string, kind string, attempt string, image binary")
    makes = (record_queries.WrittenText, record_queries.WrittenNumbers, record_queries.WrittenDates)
    one = cards.crop_readings(crops, *makes)
    three = cards.engine_readings(*(engines.read_crops(crops, make) for make in makes))
    order = ["capture_id", "field", "attempt_no"]
    assert one.orderBy(order).collect() == three.select(one.columns).orderBy(order).collect() and one.count() == 8
    assert "Join" not in one._jdf.queryExecution().optimizedPlan().toString()
    read = engines.read_by(crops, {"a_": (record_queries.WrittenDates, {"date"}), "b_": (record_queries.WrittenText, None)}).orderBy(order[:2] + ["attempt"]).collect()
    assert [(r["a_raw"], r["a_conf"], r["a_error"]) for r in read if r["kind"] != "date"] == [(None, 0.0, None)] * 6 and [r["a_raw"] for r in read if r["kind"] == "date"] == ["1380/05/12", "13999999"]


def test_values_bound_as_columns(spark):
    """Codes, dates and names read the same whether bound values are lambda variables or columns, which leave no lambda around the rules."""
    texts = ["1234567891", "0404796669", "0750020101", "4942055526", "5162046610", "12", "", None, "۱۳۸۰/۵/۷", "1425/03/12", "12/03/1380", "13800512", "1380/15/20", "99991231", "علی رضا ب", "نام محمد"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    makes = {"code": lambda: codes.read_code(F.col("t"), F.lit(0.8)), "date": lambda: jalali.read_date(F.col("t")), "name": lambda: text.name_tokens(F.col("t"))}
    bound = with_bound(df, **makes)
    assert bound.columns == ["k", "t", "code", "date", "name"]
    assert bound.orderBy("k").collect() == df.select("k", "t", *[make().alias(name) for name, make in makes.items()]).orderBy("k").collect()
    read = spark.createDataFrame([(1, "first_name", 0, "علی", 0.9)], "capture_id int, field string, attempt_no int, raw string, conf double")
    lines = spark.createDataFrame([], "capture_id int, line_no int, text string, confidence double, cx double, cy double, h double")
    assert len(cards.records(read, lines)._jdf.queryExecution().optimizedPlan().toString().split("Project [")) > 5


def test_uncut_crops_and_repeated_readings(spark):
    read = spark.createDataFrame([(1, "national_id", 0, None, 0.0, True), (1, "first_name", 0, "علی", 0.9, False), (2, "first_name", 0, "علی", 0.9, None), (2, "first_name", 0, "علی", 0.9, None)], "capture_id int, field string, attempt_no int, raw string, conf double, uncut boolean")
    lines = spark.createDataFrame([(1, 0, "شماره ملی", 0.9, 300.0, 100.0, 20.0), (1, 1, "12", 0.9, 100.0, 105.0, 20.0), (9, 0, "x", 0.9, 1.0, 1.0, 1.0)], "capture_id int, line_no int, text string, confidence double, cx double, cy double, h double")
    got = {r["capture_id"]: r for r in cards.records(read, lines).collect()}
    assert set(got) == {1, 2}
    assert "no_crop:national_id" in got[1]["warnings"] and got[1]["data"]["national_id"] == "12" and "partial_code:national_id" in got[1]["warnings"]
    assert "nothing_read:national_id" in got[2]["warnings"] and "no_lines:national_id" in got[2]["warnings"] and got[2]["data"]["first_name"] == "علی"


def test_approvals(spark, tmp_path):
    line = lambda k, name, at, **more: json.dumps({"capture_id": k, "first_name": name, "birth_date": {"jalali": "1380/01/02"}, "approved_at": at} | more)
    land = tmp_path / "land"
    land.mkdir()
    (land / "a.json").write_text("\n".join([line("1", "x", "2024-01-01T00:00:00Z"), line("1", "y", "2024-01-02T00:00:00Z"), line("2", "z", "2024-01-01T00:00:00Z"), "{broken", "", line("3", "w", "no time"), json.dumps({"first_name": "nobody"})]))
    good, bad = approvals.read_corrections(spark, str(land))
    assert good.count() == 3 and sorted(r["line"][:7] for r in bad.collect()) == sorted(["{broken", line("3", "w", "no time")[:7], json.dumps({"first_name": "nobody"})[:7]])
    target = str(tmp_path / "approved")
    assert approvals.upsert(spark, target, good, ["capture_id"], buckets=4)
    names = lambda: {r["capture_id"]: r["first_name"] for r in spark.read.parquet(target).collect()}
    assert names() == {"1": "y", "2": "z"}
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "approved").rglob("*.parquet")}
    assert approvals.upsert(spark, target, good, ["capture_id"], buckets=4) == []  # a second run changes nothing
    assert {f: f.stat().st_mtime_ns for f in (tmp_path / "approved").rglob("*.parquet")} == before
    (land / "a.json").write_text("\n".join([line("2", "old", "2023-01-01T00:00:00Z"), line("1", "new", "2024-03-01T00:00:00Z"), line("4", "v", "2024-03-01T00:00:00Z")]))
    again, _ = approvals.read_corrections(spark, str(land))
    assert approvals.upsert(spark, target, again, ["capture_id"], buckets=4)
    assert names() == {"1": "new", "2": "z", "4": "v"} and spark.read.parquet(target).count() == 3


def test_several_corrections_of_a_key(spark):
    read = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "k int, name string, other int")
    fixes = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (1, "z", 0), (7, "q", 1)], "k int, name string, at int")
    assert sorted(map(tuple, review.approved(read, fixes, ["k"], ["name"], "at").collect())) == [(1, "y", 5, True), (2, "b", 6, False)]
