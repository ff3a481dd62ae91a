"""Golden cases of the Column functions, and properties against plain Python."""

import random

from pyspark.sql import functions as F

from idweave.functions import codes, geometry, jalali, text, vectors


def column(spark, values, make, kind="string"):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r["out"] for r in rows.select("k", make(F.col("v")).alias("out")).orderBy("k").collect()]


def check_digit(nine: str) -> str:
    r = sum(int(c) * (10 - i) for i, c in enumerate(nine)) % 11
    return str(r if r < 2 else 11 - r)


def valid(code: str) -> bool:
    return len(code) == 10 and code.isdigit() and len(set(code)) > 1 and check_digit(code[:9]) == code[9]


def test_check_digits(spark):
    golden = ["1234567891", "1234567890", "1111111111", "12", None, "", "1718615981"]
    assert column(spark, golden, codes.is_valid) == [True, False, False, False, False, False, True]
    rng = random.Random(1)
    some = ["".join(rng.choice("0123456789") for _ in range(10)) for _ in range(300)] + [(n := "".join(rng.choice("0123456789") for _ in range(9))) + check_digit(n) for _ in range(100)]
    assert column(spark, some, codes.is_valid) == [valid(c) for c in some]


def test_repairs(spark):
    single = column(spark, ["0404796669", "0750020101", "4942055526", "1234567891", "x", None], codes.repair_single)
    assert [(r["code"], r["ambiguous"]) for r in single] == [("5404796669", False), (None, True), (None, False), ("1234567891", False), (None, False), (None, False)]
    many = column(spark, ["4942055526", "5162046610", "2006756003", "0748337887", None, ""], codes.repair_multi)
    assert many == ["4942505526", None, None, None, None, None]
    read = column(spark, ["ID ۱۲۳۴۵۶۷۸۹۱", "12", "", "0404796669"], lambda v: codes.read_code(v, F.lit(1.0)))
    assert [(r["value"], r["confidence"], r["valid"]) for r in read] == [("1234567891", 1.0, True), ("12", 0.4, False), (None, 0.0, False), ("5404796669", 0.9, True)]


DATES = {
    "1380/05/12": ("1380/05/12", "2001-08-03", 0.85),
    "۱۳۸۰/۵/۷": ("1380/05/07", "2001-07-29", 0.85),
    "13800512": ("1380/05/12", "2001-08-03", 0.55),
    "400512": ("1400/05/01", "2021-07-23", 0.55),
    "1399/12/30": ("1399/12/30", "2021-03-20", 0.85),
    "1400/12/30": ("1400/12/30", None, 0.34),
    "1275/01/01": ("1275/01/01", "1896-03-20", 0.425),
    "12/03/1380": (None, None, 0.0),
    "1425/03/12": ("1425/03/12", "2046-06-02", 0.85),
    "99991231": ("9999/12/31", None, 0.11),
    "abc": (None, None, 0.0),
    "": (None, None, 0.0),
}


def test_dates(spark):
    got = column(spark, list(DATES), jalali.parse)
    assert [(r["jalali"], str(r["iso"]) if r["iso"] else None, round(r["confidence"], 6)) for r in got] == list(DATES.values())
    final = column(spark, ["1425/03/12", "1459/05/01", "1421/01/01", "12/03/1380", "1380/15/20", "1240/01/01", None], jalali.read_date)
    assert [r["jalali"] for r in final] == ["1420/03/12", "1409/05/01", None, None, None, None, None]
    assert list(final[3]["candidates"]) == ["1380/03/12", "1385/03/12"]
    assert list(final[4]["candidates"]) == ["1380/10/20", "1380/10/25", "1385/10/20", "1385/10/25"]
    assert column(spark, ["1425/03/12"], lambda v: jalali.read_date(v, strict_years=False))[0]["jalali"] == "1425/03/12"
    assert "1380/12/3" in column(spark, ["3/12/1380"], jalali.all_candidates)[0]


def test_text(spark):
    assert column(spark, ["۱۲٣", None, "a"], text.normalize_digits) == ["123", "", "a"]
    assert column(spark, ["علي‌رضا (ك)؛  x", None], text.normalize_text) == ["علی رضا ک x", ""]
    assert column(spark, ["نام محمد", "ایرانی", "محمد رضا ب", None], text.name_tokens) == ["محمد", None, "محمد رضا", None]
    assert column(spark, ["متحمد نام!", None], text.clean_free_text) == ["محمد", None]
    assert column(spark, ["a1/۲-b"], lambda v: text.allowed(v, text.DATE_CHARACTERS)) == ["1/۲-"]


def test_vectors_and_geometry(spark):
    row = spark.range(1).select(
        vectors.soft_iou(vectors.dot(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))), F.lit(1.0), F.lit(2.0)).alias("s"),
        vectors.soft_iou(F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("z"),
        vectors.rolled(F.array(*[F.lit(k) for k in range(4)]), 2, 1, 0).alias("r"),
        geometry.center_box(F.lit(1000), F.lit(1000)).alias("c"),
    ).first()
    assert (row["s"], row["z"], row["r"]) == (0.5, 0.0, [2, 3, 0, 1])
    assert row["c"]["x2"] - row["c"]["x1"] == 960
