"""Check digits of ten-digit identity codes, and bounded repair of confused 0 and 5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from idweave.functions.binding import bind, named, only_where
from idweave.functions.text import only_digits

CODE = r"\A[0-9]{10}\z"
MOST_POSITIONS, MOST_FLIPS = 4, 3
SINGLE_FACTOR, MULTI_FACTOR, PARTIAL_FACTOR = 0.9, 0.85, 0.4


def digit(code: Column, k: int) -> Column:
    return F.ascii(F.substring(code, k, 1)) - 48


def is_valid(code: Column) -> Column:
    """Ten digits, not all alike, whose last one is the check digit (weights 10 down to 2, modulo 11); null is false."""
    total = sum((digit(code, k) * (11 - k) for k in range(2, 10)), digit(code, 1) * 10)
    rest = total % 11
    alike = F.translate(code, "0123456789", "0000000000") == F.repeat(F.lit("0"), F.lit(10))
    same = F.replace(code, F.substring(code, 1, 1), F.lit("")) == ""
    check = F.when(rest < 2, rest).otherwise(11 - rest)
    return F.coalesce(F.when(code.rlike(CODE) & alike & ~same, digit(code, 10) == check), F.lit(False))


def checks(total: Column, check: Column) -> Column:
    """Whether a check digit fits a weighted sum of the other nine digits."""
    rest = F.pmod(total, F.lit(11))
    return check == F.when(rest < 2, rest).otherwise(11 - rest)


def places(code: Column) -> Column:
    """Struct total, check and at: a struct for each place k of a 0 or 5, with what reading it as the other adds.

    ``moves`` is what the weighted sum changes by and ``turns`` what the check digit changes by, so that every repair is
    judged by small sums and only the one chosen is written out.
    """
    total = sum((digit(code, k) * (11 - k) for k in range(2, 10)), digit(code, 1) * 10)
    step = lambda k: 5 - 2 * digit(code, k)
    place = lambda k: F.when(F.substring(code, k, 1).isin("0", "5"), F.struct(F.lit(k).alias("k"), (step(k) * (11 - k) if k < 10 else F.lit(0)).alias("moves"), (step(k) if k == 10 else F.lit(0)).alias("turns")))
    return F.struct(total.alias("total"), digit(code, 10).alias("check"), F.array_compact(F.array(*[place(k) for k in range(1, 11)])).alias("at"))


def with_flips(code: Column, at: Column) -> Column:
    """code with the places of ``at`` read as the other of 0 and 5."""
    return F.aggregate(at, code, lambda c, p: F.overlay(c, F.translate(F.substring(c, p["k"], F.lit(1)), "05", "50"), p["k"]))


def single_fits(code: Column, s: Column) -> Column:
    """Places whose one flip makes a valid code. Ten digits alike are none, which one flip can only reach by its own place."""
    alike = lambda p: F.replace(with_flips(code, F.array(p)), F.translate(F.substring(code, p["k"], F.lit(1)), "05", "50"), F.lit("")) == ""
    fits = F.filter(s["at"], lambda p: checks(s["total"] + p["moves"], s["check"] + p["turns"]))
    return F.when(F.size(s["at"]) < 10, fits).otherwise(F.filter(fits, lambda p: ~alike(p)))


def multi_fits(s: Column) -> Column:
    """Masks over the places whose flips, ``MOST_FLIPS`` at most, make a valid code; for ``MOST_POSITIONS`` places at most."""
    n = F.size(s["at"])
    masks = F.filter(F.sequence(F.lit(1), F.pow(F.lit(2), F.least(n, F.lit(MOST_POSITIONS))).cast("int") - 1), lambda m: F.bit_count(m) <= MOST_FLIPS)
    part = lambda m, what: sum((F.getbit(m, F.lit(i)).cast("int") * F.coalesce(F.get(s["at"], F.lit(i))[what], F.lit(0)) for i in range(1, MOST_POSITIONS)), F.getbit(m, F.lit(0)).cast("int") * F.get(s["at"], F.lit(0))[what])
    return F.when(n.between(1, MOST_POSITIONS), F.filter(masks, lambda m: checks(s["total"] + part(m, "moves"), s["check"] + part(m, "turns"))))


def single_of(code: Column, s: Column, valid: Column) -> Column:
    choose = lambda f: F.struct(F.when(F.size(f) == 1, with_flips(code, f)).alias("code"), (F.size(f) > 1).alias("ambiguous"))
    return F.when(valid, F.struct(code.alias("code"), F.lit(False).alias("ambiguous"))).otherwise(only_where(~valid, lambda: bind(single_fits(code, s), choose)))


def multi_of(code: Column, s: Column) -> Column:
    chosen = lambda m: F.filter(s["at"], lambda p, i: F.getbit(m, i) == 1)
    return bind(multi_fits(s), lambda f: F.when(F.size(f) == 1, with_flips(code, chosen(F.element_at(f, 1)))))


def repair_single(code: Column) -> Column:
    """Struct code, ambiguous: a valid code itself, the only valid single swap, or null; ambiguous if there are several."""
    none = F.struct(F.lit(None).cast("string").alias("code"), F.lit(False).alias("ambiguous"))
    return F.when(code.rlike(CODE), bind(places(code), lambda s: single_of(code, s, is_valid(code)))).otherwise(none)


def repair_multi(code: Column) -> Column:
    """The only valid code within three flips of 0 and 5, where at most four places hold one; else null."""
    return F.when(code.rlike(CODE), bind(places(code), lambda s: multi_of(code, s)))


def repaired_code(code: Column) -> Column:
    """Struct class, value of ten digits: valid, corrected (single swap), repaired (several flips), ambiguous or invalid."""

    def made(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("class"), value.alias("value"))

    def multi(s: Column, one: Column) -> Column:
        return bind(multi_of(code, s), lambda many: F.when(many.isNotNull(), made("repaired", many)).when(one["ambiguous"], made("ambiguous", code)).otherwise(made("invalid", code)))

    def single(s: Column) -> Column:
        return bind(single_of(code, s, F.lit(False)), lambda one: F.when(one["code"].isNotNull(), made("corrected", one["code"])).otherwise(only_where(one["code"].isNull(), lambda: multi(s, one))))

    valid, whole = named(is_valid(code)), code.rlike(CODE)
    return F.when(valid, made("valid", code)).when(whole, only_where(~valid & whole, lambda: bind(places(code), single))).otherwise(made("invalid", code))


def code_class(code: Column) -> Column:
    """valid, corrected (single swap), repaired (several flips), ambiguous or invalid."""
    return repaired_code(code)["class"]


def read_code(raw: Column, confidence: Column) -> Column:
    """Struct value, confidence, valid, note of an identity code read with a confidence.

    The first ten digits in a row are the code; without them the digits there are stay as a partial value.
    """
    factor = {"valid": 1.0, "corrected": SINGLE_FACTOR, "repaired": MULTI_FACTOR}

    def made(value: Column, weight: Column, valid: Column, note: Column) -> Column:
        return F.struct(value.alias("value"), F.round(confidence * weight, 3).alias("confidence"), valid.alias("valid"), note.alias("note"))

    def of(r: Column) -> Column:
        weight = F.when(r["class"] == "corrected", factor["corrected"]).when(r["class"] == "repaired", factor["repaired"]).otherwise(1.0)
        return made(r["value"], weight, r["class"].isin(*factor), F.when(~r["class"].isin("valid", "invalid"), r["class"]))

    def read(d: Column) -> Column:
        part = F.nullif(d, F.lit(""))
        partial = made(part, F.when(part.isNotNull(), PARTIAL_FACTOR).otherwise(0.0), F.lit(False), F.when(part.isNotNull(), "partial"))
        whole = d.rlike("[0-9]{10}")
        return F.when(whole, only_where(whole, lambda: bind(F.regexp_extract(d, "[0-9]{10}", 0), lambda c: bind(repaired_code(c), of)))).otherwise(partial)

    return bind(only_digits(raw), read)
