"""Text functions as Column expressions; only Unicode normalisation leaves the JVM."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

CM_PER_PIXEL = 2.54 / 96


def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: t if not t or t.isascii() else unicodedata.normalize("NFC", t))


def nfc(c: str | Column) -> Column:
    """Unicode NFC; null and empty stay as they are."""
    return F.pandas_udf(_nfc, StringType())(c)


def _nfc_each(s: pd.Series) -> pd.Series:
    return s.map(lambda ts: None if ts is None else [t if not t or t.isascii() else unicodedata.normalize("NFC", t) for t in ts])


def nfc_each(c: str | Column) -> Column:
    """Unicode NFC of every text of an array."""
    return F.pandas_udf(_nfc_each, ArrayType(StringType()))(c)


def strip(c: Column) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_upper(c: Column) -> Column:
    """At least one cased letter and none of lower case."""
    return (F.upper(c) == c) & (F.lower(c) != c)


def is_digits(c: Column) -> Column:
    return c.rlike(r"(?U)^\d+$")


def is_reference(c: Column) -> Column:
    """A citation: a number, then a capitalised Latin word or an abbreviation."""
    return strip(c).rlike(r"(?U)^\d+\s+(?:[A-Z][a-z]+|[a-z]+\.)\s")


def is_footnote_marker(c: Column) -> Column:
    return strip(c).rlike(r"(?U)^(\d+|\*)\s+[^\d]")


def html_escape(c: Column) -> Column:
    """Ampersand and angle brackets escaped; quotation marks stay."""
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def html_escape_quotes(c: Column) -> Column:
    """`html_escape` and both kinds of quotation marks."""
    return F.replace(F.replace(html_escape(c), F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#x27;"))


def band(y: Column, height: int = 5) -> Column:
    """The multiple of `height` nearest to y, ties to the even one."""
    return (F.bround(y / height) * height).cast("int")


def scale_factor(width_cm: Column, width_px: Column) -> Column:
    """How much smaller a page is drawn than its pixels at 96 to the inch; null for a page without width."""
    return F.try_divide(width_cm, width_px * CM_PER_PIXEL)


def pixels_to_cm(px: Column) -> Column:
    return px * CM_PER_PIXEL * 0.5


def squeeze_lines(c: Column) -> Column:
    """White space in each line collapsed to one space, line breaks kept, ends stripped."""
    return strip(F.array_join(F.transform(F.split(c, "\n"), lambda x: strip(F.regexp_replace(x, r"(?U)\s+", " "))), "\n"))
