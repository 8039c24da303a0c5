"""Row-level text rules as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# What may stand between the thousands of a number, phrases that open a limit, and how OCR is distrusted.
THOUSANDS = "[ \u00a0\u202f\u2009'’]"
LIMIT_PHRASES = ("не более", "не менее", "до ", "от ", "свыше ")
CRITICAL_OCR = "[0-9+\u2212\u00b1\u00b3\u00b2=%<>]"
NUMBER = rf"(?<!\d)[+-]?(?:\d{{1,3}}(?:{THOUSANDS}\d{{3}})+(?:[,.]\d+)?|\d+(?:[,.]\d+)?)(?!\d)"
#: The same without look-around, for engines that lack it, on texts whose numbers have spaces around them.
PLAIN_NUMBER = r"[+-]?\d+(?:[,.]\d+)?"


def normalised(col: Column, form: str = "NFC", fold: bool = False) -> Column:
    """Unicode normal form, and full case folding if asked, in Arrow batches: Spark has no function for them. Null stays null."""

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        plain = lambda t: t if t.isascii() else unicodedata.normalize(form, t)
        return texts.map(lambda t: t if t is None else plain(t).casefold() if fold else plain(t))

    return of(col)


def collapsed(col: Column) -> Column:
    """White space runs to one space, edges trimmed."""
    return F.trim(F.regexp_replace(col, r"(?U)\s+", " "))


def prepare_query(col: Column, most: int = 4000) -> Column:
    """The search form of a question; null where it is blank or over `most` characters."""
    plain = collapsed(normalised(col))
    return F.when((plain != "") & (F.char_length(col) <= most), plain)


def subject(col: Column, form: str = "NFC") -> Column:
    """A row subject for comparison: case folded, ё as е, single spaces, no punctuation at the edges."""
    return F.btrim(F.regexp_replace(F.translate(normalised(col, form, fold=True), "ё", "е"), r"(?U)\s+", " "), F.lit(" \t\r\n.,;:()[]{}"))


def word_prefix(a: Column, b: Column) -> Column:
    """One of two subjects is a proper prefix of the other that ends at a word's end."""

    def one(x: Column, y: Column) -> Column:
        after = F.substr(y, F.char_length(x) + 1, F.lit(1))
        return (x != "") & (x != y) & y.startswith(x) & ~after.rlike(r"(?U)[\w]")

    return one(a, b) | one(b, a)


def textual_subject(col: Column) -> Column:
    """Has a letter and opens neither with a digit nor with a limit phrase."""
    low = F.lower(F.trim(col))
    limit = F.lit(False)
    for phrase in LIMIT_PHRASES:
        limit = limit | low.startswith(phrase)
    return low.rlike(r"(?U)\p{L}") & ~low.rlike(r"(?U)^\d") & ~limit


def numeric_value(col: Column) -> Column:
    return col.rlike(r"\d")


def damaged(col: Column) -> Column:
    """Has the replacement character, or a control character other than tab, line feed and return."""
    return col.rlike("[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x9f�]")


def critical_ocr(col: Column) -> Column:
    return col.rlike(CRITICAL_OCR)


def canonical_number(col: Column) -> Column:
    """One number without thousands separators, with a decimal point and no plus sign.

    A single separator before exactly three digits may be either kind, so such a number stays as it is written.
    """
    unsigned = F.regexp_replace(col, r"^[+-]+", "")
    grouped = unsigned.rlike(rf"^\d{{1,3}}(?:{THOUSANDS}\d{{3}})+(?:[,.]\d+)?$")
    compact = F.when(grouped, F.regexp_replace(col, rf"(?<=\d){THOUSANDS}(?=\d)", "")).otherwise(col)
    sign = F.when(compact.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    body = F.regexp_replace(compact, r"^[+-]", "")
    decimal = body.rlike(r"^[^,.]*[,.](?:[^,.]{0,2}|[^,.]{4,})$")
    return F.when(col.rlike(r"^-?[0-9]+(?:\.[0-9]+)?$"), col).otherwise(F.concat(sign, F.when(decimal, F.translate(body, ",", ".")).otherwise(body)))


def numeric_literals(col: Column) -> Column:
    """The distinct canonical numbers of a text, in order of first appearance."""
    return F.array_distinct(F.transform(F.regexp_extract_all(col, F.lit(NUMBER), F.lit(0)), canonical_number))
