"""Repair of identity codes under any table of digits taken for each other, without writing out a single variant.

A variant is the sum of its changes: what they add to the weighted sum modulo 11, and to the code as a number. Sums of one change
more are made from those before by changes at later places, as many levels as digits may change; those whose check digit fits are
counted. Where they are exactly one, the code plus what it adds is the repair.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from idweave.functions.binding import bind
from idweave.functions.codes import CODE, MOST_FLIPS, MOST_POSITIONS, digit, is_valid

ZERO_FIVE = {"0": "5", "5": "0"}
SUM_MODULO = 11
LENGTH = 10


def meant(table: Mapping[str, str]) -> list[list[int]]:
    """For every digit read, the other digits that may have been meant; a digit for itself is no confusion."""
    return [sorted({int(x) for x in table.get(str(d), "") if x != str(d)}) for d in range(10)]


def listed_changes(code: Column, own: list[list[int]]) -> Column:
    """Structs k, by, more for every digit of the first nine that may have been meant otherwise: its place, by how much the weighted
    sum changes modulo 11, and by how much the code does. Looked up in a fixed table by place and digit."""

    def change(k: int, read: int, d: int) -> Column:
        return F.struct(F.lit(k).alias("k"), F.lit((d - read) * (11 - k) % SUM_MODULO).alias("by"), F.lit((d - read) * 10 ** (LENGTH - k)).cast("long").alias("more"))

    kind = "array<struct<k: int, by: int, more: bigint>>"
    table = F.array(*[F.array(*[change(k, read, d) for d in own[read]]).cast(kind) for k in range(1, LENGTH) for read in range(10)])
    return F.flatten(F.transform(F.sequence(F.lit(1), F.lit(LENGTH - 1)), lambda k: F.get(table, (k - 1) * 10 + digit(code, k))))


def with_one_more(sums: Column, changes: Column) -> Column:
    """Sums of one more change, at a later place than all before."""
    added = lambda s: F.transform(F.filter(changes, lambda c: c["k"] > s["k"]), lambda c: F.struct(c["k"].alias("k"), (s["by"] + c["by"]).alias("by"), (s["more"] + c["more"]).alias("more")))
    return F.flatten(F.transform(sums, added))


def valid_repairs(code: Column, table: Mapping[str, str], most_flips: int = MOST_FLIPS) -> Column:
    """Struct n, total of the valid codes that differ from ``code`` in one to ``most_flips`` digits as the table allows.

    total is what these codes, as numbers, add up to. Ten digits alike are no code. Null unless code has ten digits.
    """
    return bind(code, lambda c: F.when(c.rlike(CODE), _valid_repairs(c, meant(table), most_flips)))


def _valid_repairs(code: Column, own: list[list[int]], most_flips: int) -> Column:
    options = F.array(*[F.array(*map(F.lit, o)).cast("array<int>") for o in own])
    checks = F.array(*[F.lit(r if r < 2 else SUM_MODULO - r) for r in range(SUM_MODULO)])  # the check digit of each residue
    last = digit(code, LENGTH)

    def levels(changes: Column, body) -> Column:
        """body(list of the sums of 0, 1, ... changes)"""
        nothing = F.array(F.struct(F.lit(0).alias("k"), F.lit(0).alias("by"), F.lit(0).cast("long").alias("more")))

        def next_(found: list[Column]) -> Column:
            if len(found) > most_flips:
                return body(found)
            return bind(changes if len(found) == 1 else with_one_more(found[-1], changes), lambda sums: next_([*found, sums]))

        return next_([nothing])

    def ended(found: list[Column], f: Column) -> Column:
        """What the sums add up to whose check digit is the last digit, kept or changed."""
        check = lambda s: F.get(checks, (f["rest"] + s["by"]) % SUM_MODULO)
        kept = F.transform(F.filter(F.concat(*found[1:]), lambda s: check(s) == f["last"]), lambda s: s["more"])
        others = F.transform(F.filter(F.concat(*found[:-1]), lambda s: F.array_contains(f["alts"], check(s))), lambda s: s["more"] + check(s) - f["last"])
        more = F.when(F.size(f["alts"]) > 0, F.concat(kept, others)).otherwise(kept) if most_flips else F.array().cast("array<bigint>")
        whole = lambda m: F.struct(F.size(m).cast("long").alias("n"), (F.size(m) * f["number"] + F.aggregate(m, F.lit(0).cast("long"), lambda t, x: t + x)).alias("total"))
        return bind(more, whole)

    def same(d: int) -> Column:
        """1 if ten times d is among the repairs counted."""
        rest = d * 54 % SUM_MODULO
        valid = d == (rest if rest < 2 else SUM_MODULO - rest)
        apart = F.length(F.translate(code, str(d), ""))
        sources = "".join(str(r) for r, o in enumerate(own) if d in o)
        reached = apart.between(1, most_flips) & (F.translate(code, f"{d}{sources}", "") == "")
        return F.when(reached, 1).otherwise(0) if valid else F.lit(0)

    alike = F.array(*[same(d).cast("long") for d in range(10)])
    whole = lambda a, weigh: F.aggregate(F.transform(a, weigh), F.lit(0).cast("long"), lambda t, x: t + x)
    without = lambda s, a: F.struct((s["n"] - whole(a, lambda x, d: x)).alias("n"), (s["total"] - whole(a, lambda x, d: x * d * 1111111111)).alias("total"))
    rest = F.pmod(sum((digit(code, k) * (11 - k) for k in range(2, LENGTH)), digit(code, 1) * 10), F.lit(SUM_MODULO))
    facts = F.struct(rest.alias("rest"), code.cast("long").alias("number"), last.alias("last"), F.get(options, last).alias("alts"))
    sums = bind(facts, lambda f: bind(listed_changes(code, own), lambda changes: levels(changes, lambda found: ended(found, f))))
    # ten digits alike are only reached by a code that has so many alike already
    nearly = code.rlike(r"([0-9])(?:[0-9]*\1){%d}" % max(LENGTH - most_flips - 1, 0))
    return bind(sums, lambda s: F.when((s["n"] > 0) & nearly, bind(alike, lambda a: without(s, a))).otherwise(s))


def repair_pairs(code: Column, table: Mapping[str, str] = ZERO_FIVE, most_flips: int = MOST_FLIPS, most_places: int = MOST_POSITIONS) -> Column:
    """Struct class, value, repairs of ten digits: valid, repaired (by the only repair there is), ambiguous or invalid.

    repairs is how many valid codes there are within ``most_flips`` changes; it is 0 where more than ``most_places`` digits may
    have been meant otherwise, since chance would then find one. A valid code has none and stays.
    """
    wrong = "".join(str(d) for d, own in enumerate(meant(table)) if own)
    made = lambda name, value, n: F.struct(F.lit(name).alias("class"), value.alias("value"), n.cast("long").alias("repairs"))

    def judged(c: Column) -> Column:
        nothing = made("invalid", c, F.lit(0))
        chosen = lambda s: F.when(s["n"] == 1, made("repaired", F.lpad(s["total"].cast("string"), LENGTH, "0"), s["n"])).when(s["n"] > 1, made("ambiguous", c, s["n"])).otherwise(nothing)
        places = F.length(c) - F.length(F.translate(c, wrong, ""))
        return F.when(is_valid(c), made("valid", c, F.lit(0))).when((places > 0) & (places <= most_places) & c.rlike(CODE), bind(valid_repairs(c, table, most_flips), chosen)).otherwise(nothing)

    return bind(code, judged)
