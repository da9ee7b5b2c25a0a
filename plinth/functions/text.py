"""Text of values: display, patterns, concat, trim and split."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .cells import blank

#: Patterns that toText knows (fixed values), with Spark's date patterns or digits and scale.
DATE_PATTERNS = {"yyyy-mm-dd": "yyyy-MM-dd", "dd/mm/yyyy": "dd/MM/yyyy", "mm/dd/yyyy": "MM/dd/yyyy", "yyyy-mm": "yyyy-MM", "mmm yyyy": "MMM yyyy", "yyyy": "yyyy"}
NUMBER_PATTERNS = {"0": (0, False, 1), "0.00": (2, False, 1), "#,##0": (0, True, 1), "#,##0.00": (2, True, 1), "0%": (0, False, 100), "0.0%": (1, False, 100)}


def significant(x: Column) -> Column:
    """A double rounded to 15 significant digits."""
    return F.format_string("%.14e", x).cast("double")


def display(c: Column, kind: str) -> Column:
    """How a value shows inside of text."""
    if kind == "text":
        return c
    if kind == "bool":
        return F.upper(c.cast("string"))
    if kind == "date":
        return F.date_format(c, "yyyy-MM-dd")
    if kind == "datetime":
        whole = c == F.date_trunc("day", c)
        return F.when(whole, F.date_format(c, "yyyy-MM-dd")).otherwise(F.date_format(c, "yyyy-MM-dd HH:mm"))
    x = c.cast("double")
    near = significant(x)
    size = F.abs(near)
    plain = F.regexp_replace(F.regexp_replace(near.try_cast("decimal(38,24)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    wide = F.format_string("%.0f", near)
    power = F.regexp_replace(F.regexp_replace(F.format_string("%.14e", x), r"\.?0+e", "e"), r"e([+-])0*(\d)", "E$1$2")
    shown = F.when(size == 0, "0").when((size >= 1e21) | (size < 1e-9), power).when((size >= 2.0**53) | (near == F.floor(near)), wide).otherwise(plain)
    return F.when(c.isNotNull(), shown)


def pattern_text(c: Column, pattern: str, kind: str) -> Column:
    if kind in ("date", "datetime"):
        return F.date_format(c, DATE_PATTERNS[pattern])
    digits, thousands, scale = NUMBER_PATTERNS[pattern]
    rounded = F.round(significant(c.cast("double") * scale), digits)
    shown = F.format_number(F.when(rounded == 0, F.lit(0.0)).otherwise(rounded), digits)
    shown = shown if thousands else F.regexp_replace(shown, ",", "")
    return F.concat(shown, F.lit("%")) if scale == 100 else shown


def trim(c: Column) -> Column:
    """Any white space off both ends; inner runs of spaces become one."""
    return F.regexp_replace(F.regexp_replace(c, " +", " "), r"(?U)^\s+|\s+$", "")


def split_part(c: Column, sep: str, index: int) -> Column:
    """The part between literal separators, from 1; null past the end."""
    return F.get(F.split(c, re.sub(r"([^\w\s])", r"\\\1", sep), -1), index - 1)


def concat(parts: list[Column], sep: str, skip_blanks: bool) -> Column:
    if skip_blanks:
        shown = [F.when(~blank(p, True), p) for p in parts]
        joined = F.concat_ws(sep, *shown)
    else:
        shown = parts
        joined = F.concat_ws(sep, *[F.coalesce(p, F.lit("")) for p in parts])
    nothing = shown[0].isNull()
    for p in shown[1:]:
        nothing = nothing & p.isNull()
    return F.when(~nothing, joined)
