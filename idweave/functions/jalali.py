"""Solar Hijri dates: parsing, conversion and repair of confused 0 and 5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from idweave.functions.binding import bind, inlined, named, only_where
from idweave.functions.text import normalize_digits, only_digits

# Fixed values.
SEPARATED = r"(1[234]\d{2})\D{1,3}(\d{1,2})\D{1,3}(\d{1,2})"
BARE = r"(1[234]\d{2})(\d{2})(\d{2})"
PLAUSIBLE_YEARS = (1280, 1450)
HARD_YEARS = (1250, 1420)
SEPARATED_CONFIDENCE, BARE_CONFIDENCE, REPAIRED_CONFIDENCE = 0.85, 0.55, 0.6
YEAR_FACTOR, CALENDAR_FACTOR = 0.5, 0.4
LEAP_RESTS = (1, 5, 9, 13, 17, 22, 26, 30)


def is_leap(year: Column) -> Column:
    return (year % 33).isin(*LEAP_RESTS)


def month_days(year: Column, month: Column) -> Column:
    return F.when(month <= 6, 31).when(month <= 11, 30).when(is_leap(year), 30).otherwise(29)


def to_gregorian(year: Column, month: Column, day: Column) -> Column:
    """The date, or null where the calendar has no such day."""
    y = year - 979
    days = y * 365 + F.floor(y / 33) * 8 + F.floor((F.pmod(y, F.lit(33)) + 3) / 4)
    days = days + F.when(month <= 7, (month - 1) * 31).otherwise((month - 7) * 30 + 186) + day - 1 + 79
    sound = month.between(1, 12) & (day >= 1) & (day <= month_days(year, month))
    return F.when(sound, F.date_add(F.lit("1600-01-01").cast("date"), days.cast("int")))


def date_parts(raw: Column) -> Column:
    """Struct y, m, d, confidence, joined of the first date in a text; null where there is none. joined: without separators."""
    made = lambda parts, c: F.struct(*[p.try_cast("int").alias(n) for n, p in zip("ymd", parts)], F.lit(c).alias("confidence"), F.lit(c == BARE_CONFIDENCE).alias("joined"))
    cut = lambda s, a, n: F.substring(s, a, n)

    def of(text: Column) -> Column:
        bare = lambda d: F.when(F.length(d) == 8, made([cut(d, 1, 4), cut(d, 5, 2), cut(d, 7, 2)], BARE_CONFIDENCE)).when((F.length(d) == 6) & cut(d, 1, 1).isin("3", "4"), made([F.concat(F.lit("1"), cut(d, 1, 3)), cut(d, 4, 1), cut(d, 5, 1)], BARE_CONFIDENCE))
        found = lambda m: F.when(F.size(m) == 4, made([F.get(m, F.lit(k)) for k in (1, 2, 3)], SEPARATED_CONFIDENCE)).otherwise(only_where(F.size(m) != 4, lambda: bind(only_digits(text), bare)))
        # the whole match and its groups, from one search
        groups = lambda one: F.when(one.isNotNull(), F.concat(F.array(one), F.regexp_extract_all(one, F.lit("([0-9]+)"), F.lit(1)))).otherwise(F.array().cast("array<string>"))
        return bind(bind(F.regexp_substr(text, F.lit(SEPARATED)), groups), found)

    return bind(normalize_digits(raw), of)


def parse(raw: Column) -> Column:
    """Struct jalali, iso, confidence, notes. Days the calendar lacks keep their text and lose the date.

    notes: no_date, bad_month, bad_day, no_separators, odd_year, not_in_calendar.
    """

    def of(p: Column) -> Column:
        sound = F.coalesce(p["m"].between(1, 12) & p["d"].between(1, 31), F.lit(False))
        return F.when(sound, bind(to_gregorian(p["y"], p["m"], p["d"]), lambda iso: sound_date(p, iso))).otherwise(
            date_struct(F.lit(None).cast("string"), F.lit(None).cast("date"), F.lit(0.0), F.array(F.when(p.isNull(), "no_date").when(~p["m"].between(1, 12), "bad_month").otherwise("bad_day")))
        )

    return bind(date_parts(raw), of)


def date_struct(jalali: Column, iso: Column, confidence: Column, notes: Column) -> Column:
    return F.struct(jalali.alias("jalali"), iso.alias("iso"), confidence.alias("confidence"), notes.alias("notes"))


def sound_date(p: Column, iso: Column) -> Column:
    plausible = p["y"].between(*PLAUSIBLE_YEARS)
    confidence = p["confidence"] * F.when(plausible, 1.0).otherwise(YEAR_FACTOR) * F.when(iso.isNotNull(), 1.0).otherwise(CALENDAR_FACTOR)
    text = F.concat_ws("/", F.lpad(p["y"].cast("string"), 4, "0"), F.lpad(p["m"].cast("string"), 2, "0"), F.lpad(p["d"].cast("string"), 2, "0"))
    notes = F.array_compact(F.array(F.when(p["joined"], F.lit("no_separators")), F.when(~plausible, F.lit("odd_year")), F.when(iso.isNull(), F.lit("not_in_calendar"))))
    return date_struct(text, iso, confidence, notes)


def swap_variants(text: Column) -> Column:
    """The text and every version with one 0 and 5 confused."""
    at = F.filter(F.sequence(F.lit(1), F.length(text)), lambda k: F.substring(text, k, F.lit(1)).isin("0", "5"))
    return F.concat(F.array(text), F.transform(at, lambda k: F.overlay(text, F.translate(F.substring(text, k, F.lit(1)), "05", "50"), k)))


def ranged(variants: Column, low: int, high: int) -> Column:
    return F.filter(variants, lambda v: v.try_cast("int").between(low, high))


def dates_of(ys: Column, ms: Column, ds: Column) -> Column:
    return F.flatten(F.transform(ys, lambda a: F.flatten(F.transform(ms, lambda b: F.transform(ds, lambda c: F.concat_ws("/", a, b, c))))))


def combinations(y: Column, m: Column, d: Column) -> Column:
    """Dates y/m/d of all variants that stay within the ranges, unpadded."""
    parts = F.struct(ranged(swap_variants(y), *HARD_YEARS).alias("ys"), ranged(swap_variants(m), 1, 12).alias("ms"), ranged(swap_variants(d), 1, 31).alias("ds"))
    return bind(parts, lambda s: dates_of(s["ys"], s["ms"], s["ds"]))


def either_order(years: Column, a: Column, b: Column) -> Column:
    """As combinations, for several years and with a and b as month and day in either order; each part's variants are made once."""
    own = F.struct(F.flatten(F.transform(years, lambda y: ranged(swap_variants(y), *HARD_YEARS))).alias("ys"), swap_variants(a).alias("a"), swap_variants(b).alias("b"))
    sides = lambda s: F.struct(s["ys"].alias("ys"), *[ranged(s[c], 1, high).alias(c + n) for c in "ab" for n, high in (("m", 12), ("d", 31))])
    return bind(own, lambda s: bind(sides(s), lambda p: F.concat(dates_of(p["ys"], p["am"], p["bd"]), dates_of(p["ys"], p["bm"], p["ad"]))))


def bare_candidates(raw: Column) -> Column:
    """Candidates from each run of eight digits that starts like a year, not overlapping."""
    found = F.regexp_extract_all(only_digits(raw), F.lit("(1[234][0-9]{6})"), F.lit(1))
    return F.flatten(F.transform(found, lambda s: combinations(F.substring(s, 1, 4), F.substring(s, 5, 2), F.substring(s, 7, 2))))


def parts_of(raw: Column) -> Column:
    return F.filter(F.split(normalize_digits(raw), "[^0-9]+"), lambda p: p != "")


def listed(candidates: Column) -> Column:
    return F.array_sort(F.array_distinct(candidates))


def repair_candidates(raw: Column) -> Column:
    """Sorted different candidates of a date by the order of its three parts, or else of its digits."""

    def of(p: Column) -> Column:
        at = lambda k: F.get(p, F.lit(k))
        three = F.size(p) == 3
        ordered = F.when(three & (F.length(at(0)) == 4), p).when(three & (F.length(at(2)) == 4), F.reverse(p))
        three_ = lambda o: combinations(F.get(o, F.lit(0)), F.get(o, F.lit(1)), F.get(o, F.lit(2)))
        return bind(ordered, lambda o: F.when(o.isNotNull(), three_(o)).otherwise(bare_candidates(raw)))

    return listed(bind(parts_of(raw), of))


def all_candidates(raw: Column) -> Column:
    """Sorted candidates with month and day in either order, from up to two four-digit years; else from the digits."""

    def of(p: Column) -> Column:
        return bind(F.struct(F.slice(F.filter(p, lambda x: F.length(x) == 4), 1, 2).alias("years"), F.filter(p, lambda x: F.length(x) <= 2).alias("rest")), chosen)

    def chosen(s: Column) -> Column:
        a, b = F.get(s["rest"], F.lit(0)), F.get(s["rest"], F.lit(1))
        return F.when((F.size(s["years"]) > 0) & (F.size(s["rest"]) >= 2), either_order(s["years"], a, b)).otherwise(bare_candidates(raw))

    return listed(bind(F.filter(parts_of(raw), lambda x: F.length(x) <= 4), of))


def hard_year(jalali: Column) -> Column:
    return F.substring(jalali, 1, 4).try_cast("int").between(*HARD_YEARS)


def settled(found: Column, notes: Column) -> Column:
    """Struct jalali, iso, confidence, notes, candidates from a list of candidates: the only one, or all of several."""
    made = lambda j, c, n, all_: F.struct(j.alias("jalali"), F.lit(None).cast("date").alias("iso"), F.lit(c).alias("confidence"), n.alias("notes"), all_.alias("candidates"))
    none = F.array().cast("array<string>")
    several = made(F.lit(None).cast("string"), 0.0, notes, F.coalesce(found, none))
    return F.when(F.size(found) == 1, made(F.element_at(found, 1), REPAIRED_CONFIDENCE, F.concat(notes, F.array(F.lit("date_repaired"))), none)).otherwise(several)


def read_date(raw: Column, strict_years: bool = True) -> Column:
    """Struct jalali, iso, confidence, notes, candidates: parsed, or repaired to the only candidate, or several candidates.

    A parsed year outside ``HARD_YEARS`` is repaired as well, unless ``strict_years`` is off.
    """

    def of(own: Column) -> Column:
        kept = F.struct(own["jalali"].alias("jalali"), own["iso"].alias("iso"), own["confidence"].alias("confidence"), own["notes"].alias("notes"), F.array().cast("array<string>").alias("candidates"))
        mended = inlined(lambda: bind(repair_candidates(raw), lambda found: settled(found, own["notes"])))  # few dates come here
        fine = named(F.coalesce(own["jalali"].isNotNull() & (hard_year(own["jalali"]) | F.lit(not strict_years)), F.lit(False)))
        return F.when(fine, kept).otherwise(mended())

    return bind(parse(raw), of)


def read_date_either_order(raw: Column) -> Column:
    """As read_date, but from all candidates with month and day in either order, and the parsed date if its year is sound.

    The date itself is given only where it is the single candidate, always without a calendar date.
    """

    def of(own: Column) -> Column:
        sound = F.coalesce(hard_year(own["jalali"]), F.lit(False))
        every = F.array_sort(F.array_union(all_candidates(raw), F.when(sound, F.array(own["jalali"])).otherwise(F.array().cast("array<string>"))))

        def choose(found: Column) -> Column:
            same = sound & (F.element_at(found, 1) == own["jalali"])
            return bind(settled(found, own["notes"]), lambda r: F.when((F.size(found) == 1) & same, r.withField("notes", own["notes"])).otherwise(r))

        return bind(every, choose)

    return bind(parse(raw), of)
