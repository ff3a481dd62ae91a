"""Text normalisation as Column functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from idweave.functions.binding import bind

# Fixed values.
PERSIAN_DIGITS = "۰۱۲۳۴۵۶۷۸۹"
ARABIC_DIGITS = "٠١٢٣٤٥٦٧٨٩"
LATIN_DIGITS = "0123456789"
LETTERS_FROM, LETTERS_TO = "يكة", "یکه"
TO_SPACE = "‌‎‏،؛.,;:()!؟?\"'«»_/\\-"
LABEL_STEM = "[نتد]ام|نام|خانواد|وادگ|پدر|پذر|ملی|شماره|تولد|تاریخ|اعتبار|پایان|جمهوری|اسلامی|ایران|کارت"
FREE_TEXT_LABELS = ["نام", "خانوادگی", "پدر", "شمار", "ملی", "تاریخ", "تولد", "اعتبار", "ام"]
FREE_TEXT_LETTERS_FROM, FREE_TEXT_LETTERS_TO = "أإيك", "اایک"
FREE_TEXT_FIXES = {"متحمد": "محمد", "اسرانی": "ایرانی", "روح‌ااا": "روح الله"}
NAME_CHARACTERS = "ابپتثجچحخدذرزژسشصضطظعغفقکگلمنوهیءأإئآيكؤة‌ "
DIGIT_CHARACTERS = LATIN_DIGITS + PERSIAN_DIGITS + ARABIC_DIGITS
DATE_CHARACTERS = DIGIT_CHARACTERS + "/-."


def normalize_digits(text: Column) -> Column:
    """Persian and Arabic digits as ASCII ones; null gives an empty string."""
    return F.translate(F.coalesce(text, F.lit("")), PERSIAN_DIGITS + ARABIC_DIGITS, LATIN_DIGITS * 2)


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize_text(text: Column) -> Column:
    """Digits as ASCII, Arabic letters as Persian, marks and joiners as spaces, white space squeezed."""
    own = PERSIAN_DIGITS + ARABIC_DIGITS + LETTERS_FROM + TO_SPACE
    return squeezed(F.translate(F.coalesce(text, F.lit("")), own, LATIN_DIGITS * 2 + LETTERS_TO + " " * len(TO_SPACE)))


def only_digits(text: Column) -> Column:
    return F.regexp_replace(normalize_digits(text), r"(?U)\D", "")


def empty_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def clean_name(text: Column) -> Column:
    """Normalised without digits; null if nothing is left."""
    return empty_to_null(squeezed(F.regexp_replace(normalize_text(text), r"(?U)\d", "")))


def name_tokens(text: Column, stem: str = LABEL_STEM) -> Column:
    """clean_name without tokens that hold a label's stem; of several tokens, those of one or two letters go too."""
    tokens = F.filter(F.split(F.coalesce(clean_name(text), F.lit("")), " "), lambda t: (t != "") & ~t.rlike(stem))
    long_ = lambda own: F.filter(own, lambda t: F.char_length(t) > 2)
    return bind(tokens, lambda own: empty_to_null(F.array_join(F.when(F.size(own) > 1, long_(own)).otherwise(own), " ")))


def clean_free_text(text: Column) -> Column:
    """Labels out, letters folded, known misreadings mended, then only word characters, white space and slashes."""
    out = reduce(lambda c, label: F.replace(c, F.lit(label), F.lit("")), FREE_TEXT_LABELS, text)
    out = F.translate(out, FREE_TEXT_LETTERS_FROM, FREE_TEXT_LETTERS_TO)
    out = reduce(lambda c, fix: F.replace(c, F.lit(fix[0]), F.lit(fix[1])), FREE_TEXT_FIXES.items(), out)
    return F.trim(F.regexp_replace(out, r"(?U)[^\w\s/]", ""))


def allowed(text: Column, characters: str) -> Column:
    """Only the characters listed: a stand-in for an engine's own character list."""
    return F.regexp_replace(text, "[^" + "".join("\\" + c if c in "-]\\^/" else c for c in characters) + "]", "")
