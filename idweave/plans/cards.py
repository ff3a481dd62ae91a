"""From crops and engine readings of each field to reviewable records and whole answers, as one declarative plan.

Readings meet once a capture, and so do its lines: two exchanges by the capture's key, after which every rule looks at
arrays of one row. A capture has some readings of six fields and the lines of one card.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idweave.functions.binding import bind, inlined, named, only_where, with_bound
from idweave.functions.codes import read_code
from idweave.functions.jalali import read_date
from idweave.functions.text import name_tokens, normalize_text, only_digits
from idweave.operators.layout import LABEL_PATTERNS, REQUIRED
from idweave.operators import engines
from idweave.operators.readings import CONFLICT, gated_attempts, matched, weighed_dates, weighed_digits
from idweave.operators.recovery import DISTANCE_WEIGHT, HEIGHTS, LEAST_LIMIT, LEFT_BONUS, RECOVERED, shown_fields
from idweave.operators.review import gate, is_missing, quality, record_columns
from idweave.operators.sizes import compiled, spread

def no_texts() -> Column:
    return F.array().cast("array<string>")


def listed(*found: Column) -> Column:
    return F.array_compact(F.array(*found))


def about(what: str, field: str, *rest: Column) -> Column:
    return F.concat(F.lit(f"{what}:{field}"), *rest)


def read_value(field: str, raw: Column, conf: Column) -> Column:
    """Struct raw, value, iso, candidates, confidence, notes of a field's reading by its rules.

    notes are warnings of the reading, as ``code:field`` and what else there is to say. A value that cannot be read is
    null; its confidence is 0.
    """

    def made(value: Column, iso: Column, candidates: Column, confidence: Column, notes: Column) -> Column:
        return F.struct(raw.alias("raw"), value.alias("value"), iso.cast("date").alias("iso"), candidates.alias("candidates"), F.coalesce(confidence, F.lit(0.0)).alias("confidence"), notes.alias("notes"))

    none = F.lit(None)

    def of_date(d: Column) -> Column:
        unread = F.when(d["jalali"].isNull(), F.when(F.size(d["candidates"]) > 0, about("ambiguous_date", field, F.lit(":"), F.array_join(d["candidates"], ","))).otherwise(about("unread_date", field)))
        return made(d["jalali"], d["iso"], d["candidates"], F.round(conf * d["confidence"], 3), F.concat(listed(unread), F.transform(d["notes"], lambda n: F.concat(n, F.lit(f":{field}")))))

    of_code = lambda c: made(c["value"], none, none.cast("array<string>"), c["confidence"], listed(F.when(c["note"].isNotNull(), F.concat(c["note"], F.lit(f"_code:{field}")))))
    of_name = lambda n: made(n, none, none.cast("array<string>"), F.when(n.isNotNull(), F.round(conf, 3)), no_texts())
    if field == "national_id":
        return bind(read_code(raw, conf), of_code)
    return bind(read_date(raw), of_date) if field.endswith("_date") else bind(name_tokens(raw), of_name)


def source(raw: Column, conf: Column, other: Column, labelled: Column) -> Column:
    return F.struct(raw.alias("raw"), conf.alias("conf"), other.alias("other"), labelled.alias("labelled"))


def from_reads(field: str, reads: Column) -> Column:
    """A field's surest reading, the first of equals; other is a different one of a confidence over a half."""
    mine = F.filter(reads, lambda r: (r["field"] == field) & (F.coalesce(r["raw"], F.lit("")) != "") & (r["conf"] > 0))
    ranked = F.transform(mine, lambda r: F.struct(r["conf"].alias("conf"), (-r["attempt_no"]).alias("first"), r["raw"].alias("raw")))
    rest = lambda own, top: F.array_max(F.filter(own, lambda r: r["raw"] != top["raw"]))
    made = lambda top, other: source(top["raw"], top["conf"], F.when(other["conf"] > CONFLICT, other["raw"]), F.lit(False))
    return bind(ranked, lambda own: bind(F.array_max(own), lambda top: bind(rest(own, top), lambda other: made(top, other))))


def from_lines(field: str, lines: Column) -> Column:
    """The best value beside the field's surest label, if there is one."""
    labels = F.transform(F.filter(lines, lambda v: F.array_contains(v["shown"], F.lit(field))), lambda v: F.struct(v["confidence"].alias("confidence"), (-v["line_no"]).alias("first"), *[v[c].alias(c) for c in ("cx", "cy", "h")]))
    made = lambda label, best: source(best["text"], best["confidence"], F.lit(None).cast("string"), label["first"].isNotNull())
    return bind(F.array_max(labels), lambda label: bind(beside(label, lines, field), lambda best: made(label, best)))


def beside(label: Column, lines: Column, field: str) -> Column:
    """Struct score, first, text, confidence of the best value in the label's band, by the rules of ``recovered``; else null."""
    limit = F.greatest(HEIGHTS * label["h"], F.lit(LEAST_LIMIT))
    digits = lambda v: F.length(only_digits(v["text"]))
    fits = lambda v: (digits(v) >= 4 if field.endswith("_date") else digits(v) <= 2) & (F.trim(v["text"]) != "")
    dy = lambda v: F.abs(v["cy"] - label["cy"])
    near = F.filter(lines, lambda v: (F.size(v["shown"]) == 0) & (v["line_no"] != -label["first"]) & (dy(v) <= limit) & fits(v))
    score = lambda v: v["confidence"] - DISTANCE_WEIGHT * dy(v) / limit + F.when(v["cx"] < label["cx"], LEFT_BONUS).otherwise(0.0)
    return F.array_max(F.transform(near, lambda v: F.struct(score(v).alias("score"), (-v["line_no"]).alias("first"), F.trim(v["text"]).alias("text"), (v["confidence"] * RECOVERED).alias("confidence"))))


def entry(field: str, reads: Column, lines: Column) -> Column:
    """Struct raw, value, iso, candidates, confidence, warnings, more_warnings of a field: by its readings, then, unless sure, by its lines.

    What lines give replaces what was there: a date in any case, its confidence only if it is a date; a code or name only if
    something is left of it. A field whose crop could not be cut says so.
    """
    uncut = F.exists(reads, lambda r: (r["field"] == field) & r["uncut"])
    facts = ("raw", "value", "iso", "candidates", "confidence")

    def first(s: Column, v: Column) -> Column:
        conflict = F.when(s["other"].isNotNull(), about("two_readings", field, F.lit(":"), s["raw"], F.lit("|"), s["other"]))
        nothing = F.when(uncut, about("no_crop", field)).otherwise(about("nothing_read", field))
        return F.struct(*[v[c].alias(c) for c in facts], F.when(s["raw"].isNull(), F.array(nothing)).otherwise(F.concat(listed(conflict), v["notes"])).alias("warnings"), no_texts().alias("more_warnings"))

    def again(e: Column, s: Column, v: Column) -> Column:
        wrote = s["raw"].isNotNull() & (v["value"].isNotNull() | F.lit(field.endswith("_date")))
        pick = [F.when(wrote, v[c]).otherwise(e[c]).alias(c) for c in facts[:-1]]
        confidence = F.when(wrote & v["value"].isNotNull(), v["confidence"]).otherwise(e["confidence"]).alias("confidence")
        more = F.when(~s["labelled"], F.array(about("no_label", field))).when(s["raw"].isNull(), F.array(about("no_value", field))).otherwise(v["notes"])
        return F.struct(*pick, confidence, e["warnings"].alias("warnings"), more.alias("more_warnings"))

    def read(found: Column, taken) -> Column:
        return bind(found, lambda s: bind(read_value(field, s["raw"], s["conf"]), lambda v: taken(s, v)))

    def sought(e: Column) -> Column:
        lost = named(is_missing(e["value"], e["confidence"]))
        without = e.withField("more_warnings", F.array(F.lit(f"no_lines:{field}")))
        found = inlined(lambda: read(from_lines(field, lines), lambda s, v: again(e, s, v)))  # few fields come here
        return F.when(lost & lines.isNull(), without).when(lost, found()).otherwise(e)

    return bind(read(from_reads(field, reads), first), sought)


def records(readings: DataFrame, lines: DataFrame, key: str = "capture_id") -> DataFrame:
    """Records from readings (key, field, attempt_no, raw, conf) and free lines (key, line_no, text, confidence, cx, cy, h).

    Every capture with a reading has a record; fields without a sure value are sought in its lines. A column ``uncut`` of
    readings, where there is one, marks fields whose crop could not be cut.
    """
    compiled(readings.sparkSession)
    uncut = F.coalesce("uncut", F.lit(False)) if "uncut" in readings.columns else F.lit(False)
    read = F.struct("field", "attempt_no", "raw", F.col("conf").cast("double").alias("conf"), uncut.alias("uncut"))
    reads = readings.groupBy(key).agg(F.collect_list(read).alias("__reads"))
    numbers = ("confidence", "cx", "cy", "h")
    free = lines.groupBy(key).agg(F.collect_list(F.struct("line_no", "text", *[F.col(c).cast("double").alias(c) for c in numbers])).alias("__lines"))
    shown = lambda v: F.struct(*[v[c].alias(c) for c in ("line_no", "text", *numbers)], bind(normalize_text(v["text"]), lambda n: shown_fields(n, LABEL_PATTERNS)).alias("shown"))
    both = reads.join(free, key, "left").withColumn("__lines", F.transform("__lines", shown))
    done = with_bound(both, **{f"__{f}": lambda f=f: entry(f, F.col("__reads"), F.col("__lines")) for f in REQUIRED})
    return done.select(key, *record_columns(lambda f, c: F.col(f"__{f}")[c]))


def engine_readings(ocr: DataFrame, template: DataFrame, again: DataFrame, key: str = "capture_id") -> DataFrame:
    """Readings for ``records`` from two engines' tables (key, field, kind, attempt, raw, conf, error) of the same crops.

    Numbers are weighed between both, dates between both and a second reading with separators (again), names are the first
    engine's. Attempts are kept only where the ones before are too weak. Where the first engine says that there was no crop,
    the field is marked as uncut; other errors leave the field unread.
    """
    keys = [key, "field", "kind", "attempt"]
    both = matched(ocr, template, keys, ("error",))
    more = again.where("kind = 'date'").select(*keys, F.col("raw").alias("r"), F.col("conf").alias("rc"))
    return weighed_readings(both.join(more, keys, "left"), key)


def crop_readings(crops: DataFrame, ocr, template, again, key: str = "capture_id") -> DataFrame:
    """As ``engine_readings``, of crops (key, field, kind, attempt, image) that three engines read in one pass, side by side.

    Nothing is joined, and crops are dealt once, as their readings, by their capture's key.
    """
    read = engines.read_by(crops, {"o_": (ocr, None), "t_": (template, None), "r_": (again, {"date"})})
    own = {"o": "o_raw", "oc": "o_conf", "error": "o_error", "t": "t_raw", "tc": "t_conf", "r": "r_raw", "rc": "r_conf"}
    return weighed_readings(read.select(key, "field", "kind", "attempt", *[F.col(c).alias(n) for n, c in own.items()]), key, dealt=False)


def weighed_readings(read: DataFrame, key: str, dealt: bool = True) -> DataFrame:
    """Readings from engines' results side by side (key, field, kind, attempt, o, oc, error, t, tc, r, rc)."""

    compiled(read.sparkSession)

    def weighed() -> Column:
        o, oc, t, tc = (F.col(c) for c in ("o", "oc", "t", "tc"))
        number, date = F.col("kind") == "number", F.col("kind") == "date"
        digits = only_where(number, lambda: weighed_digits(o, oc, t, tc))
        dates = only_where(date, lambda: weighed_dates(o, oc, t, tc, F.col("r"), F.coalesce("rc", F.lit(0.0))))
        return F.when(number, digits).when(date, dates).otherwise(F.struct(o.alias("value"), oc.alias("confidence"), F.lit("ocr").alias("rule")))

    made = with_bound(read, w=weighed).select(key, "field", "kind", "attempt", F.col("w.value").alias("raw"), F.col("w.confidence").alias("conf"), F.coalesce(F.col("error") == "no_crop", F.lit(False)).alias("uncut"))
    asked = gated_attempts(made if dealt else spread(made, key), [key, "field", "kind"])
    return asked.select(key, "field", "attempt_no", "raw", "conf", "uncut")


def responses(captures: DataFrame, records: DataFrame, key: str = "capture_id", engine: str = "tables", gpu: bool = False, phase: str = "roi-based-extraction") -> DataFrame:
    """A whole answer for each capture, from its facts and its record.

    captures: key, filename, content_type, size_bytes; width, height, blur, brightness of the frame and, with the prefix
    card_, of the card; card_detected, card_warning; photo (binary or null), face_detected, photo_warning. Warnings of the
    record come first, then the card's, the photo's and the capture's quality, which alone asks for a review as well. A
    capture without a record has an empty one.
    """
    measured = lambda p: quality(*[F.col(p + c) for c in ("width", "height", "blur", "brightness")])
    texts = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    own = captures.join(records, key, "left").withColumn("quality", measured("")).withColumn("card_quality", measured("card_"))
    said = F.concat(texts(F.col("warnings")), listed(F.col("card_warning"), F.col("photo_warning")))
    own = own.withColumn("gated", gate(F.col("quality"), said, F.coalesce("needs_review", F.lit(True))))
    return own.select(
        key,
        F.lit(True).alias("success"),
        F.uuid().alias("request_id"),
        F.lit(phase).alias("phase"),
        F.struct("filename", "content_type", F.col("size_bytes").cast("long").alias("size_bytes")).alias("file"),
        "quality",
        "card_quality",
        F.struct(F.col("card_detected").alias("detected"), F.col("card_width").cast("int").alias("width"), F.col("card_height").cast("int").alias("height")).alias("card"),
        F.struct(F.lit(engine).alias("engine"), F.lit("roi-per-field").alias("mode"), F.lit(gpu).alias("gpu")).alias("ocr"),
        "data",
        F.col("confidence").alias("field_confidence"),
        F.coalesce("validation", F.struct(F.lit(False).alias("national_id"))).alias("validation"),
        F.coalesce("missing_fields", F.array(*map(F.lit, REQUIRED))).alias("missing_fields"),
        F.struct(F.col("photo").isNotNull().alias("available"), F.coalesce("face_detected", F.lit(False)).alias("face_detected"), F.base64("photo").alias("base64_png")).alias("photo"),
        F.col("gated.warnings").alias("warnings"),
        F.col("gated.needs_review").alias("needs_review"),
        F.current_timestamp().alias("processed_at"),
    )
