"""Values from cells: numbers, percents, money, dates and error codes, all as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..functions.cells import bare, blank, once
from ..model import ERROR

#: Texts that stand for nothing (fixed values).
NULL_TOKENS = ("", "n/a", "#n/a", "-", "—", "–", "null")
#: Error codes of cells (fixed values).
ERROR_CODES = ("#N/A", "#DIV/0!", "#VALUE!", "#REF!", "#NAME?", "#NUM!", "#NULL!", "#SPILL!", "#CALC!", "#GETTING_DATA", "#FIELD!", "#BUSY!", "#BLOCKED!", "#CONNECT!", "#UNKNOWN!")
#: Currency signs and codes (fixed values).
CURRENCY_UNITS = {"$": "USD", "us$": "USD", "usd": "USD", "₹": "INR", "rs": "INR", "rs.": "INR", "inr": "INR", "€": "EUR", "eur": "EUR", "£": "GBP", "gbp": "GBP", "¥": "JPY", "jpy": "JPY"}
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
YEARS = (1900, 2200)  # of dates in text

#: One pattern takes a numeric cell apart: what is before the digits, the digits, and what is after them.
_AROUND = r"(?s)^((?:[Rr][Ss]\.|[^0-9.])*)([0-9][0-9,]*(?:\.[0-9]+)?|\.[0-9]+)(.*)$"
_GROUPED = r"[0-9]{1,3}(,[0-9]{3})+(\.[0-9]+)?"
#: Numbers with at most a sign before them, which need no taking apart, and what any other number fits: a wider pattern, cheap to check.
PLAIN_NUMBER = r"^[-+]?(?:0|[1-9][0-9]*|[1-9][0-9]{0,2}(?:,[0-9]{3})+)(?:\.[0-9]+)?$"
_LOOSE, _GAP = [r"[-+\s]*".join(map(re.escape, x)) for x in CURRENCY_UNITS], r"[-+\s]*"
_NUMBER_LIKE = rf"(?is)^{_GAP}(?:{'|'.join([*_LOOSE, '[(]'])})?{_GAP}(?:[0-9][0-9,]*(?:\.[0-9]+)?|\.[0-9]+)(?:e[-+]?[0-9]+)?\s*(?:{'|'.join([*_LOOSE, '[%)]'])})?\s*$"


def clean(c: Column) -> Column:
    return bare(c.cast("string"))


def error_code(c: Column) -> Column:
    """The cell's error code in upper case, else null."""
    return F.when(F.upper(clean(c)).isin(*ERROR_CODES), F.upper(clean(c)))


def is_null_token(c: Column) -> Column:
    return c.isNull() | F.lower(clean(c)).isin(*NULL_TOKENS)


def number_parts(c: Column) -> Column:
    """kind (number, percent, currency or null), value and unit of a text cell, as a struct.

    All null if it is no number.  The digits are read once; what stands around them says what they are: a sign, one currency sign (before
    or after), a percent sign, or parentheses for a negative.
    """
    known = F.create_map(*[F.lit(x) for pair in CURRENCY_UNITS.items() for x in pair])
    coded = [x for x in CURRENCY_UNITS if x not in ("$", "us$", "rs", "rs.", "¥")]  # those that may stand behind

    def around(t: Column) -> Column:
        part = lambda i: F.regexp_extract(t, _AROUND, i)
        return F.struct(t.alias("t"), part(1).alias("left"), part(2).alias("digits"), part(3).alias("right"), F.regexp_extract(t, r"^[-+]?[0-9]+(?:\.[0-9]+)?[eE][-+]?[0-9]+$", 0).alias("power"))

    def marks(x: Column) -> Column:
        before, after = (F.lower(F.regexp_replace(x[side], r"\s", "")) for side in ("left", "right"))
        sign = F.regexp_replace(before, "[-+]", "")
        return F.struct(
            x.alias("x"), sign.alias("sign"), (F.length(before) - F.length(sign)).alias("few"), after.alias("after"), before.contains("-").alias("minus"), F.regexp_replace(x["digits"], ",", "").try_cast("double").alias("size"),
            ((x["digits"] != "") & (~x["digits"].contains(",") | x["digits"].rlike(f"^{_GROUPED}$"))).alias("fine"), x["t"].rlike(r"^[-+]?0[0-9]").alias("zero"),  # an identifier or a postcode
        )

    def told(m: Column) -> Column:
        x = m["x"]
        unit = F.when((m["after"] == "") & (m["few"] <= 2), known[m["sign"]]).when((m["sign"] == "") & (m["few"] <= 1) & m["after"].isin(*coded), known[m["after"]])
        plain = (m["sign"] == "") & (m["few"] <= 1) & ~x["left"].rlike(r"\s")
        kind = (
            F.when(x["power"] != "", F.when(~m["zero"], "number")).when(~m["fine"], None).when(plain & (m["after"] == "%"), "percent").when(unit.isNotNull(), "currency")
            .when(m["zero"], None).when(plain & (x["right"] == ""), "number").when((x["left"] == "(") & (x["right"] == ")"), "number")
        )
        return F.struct(m.alias("m"), kind.alias("kind"), unit.alias("unit"))

    def valued(k: Column) -> Column:
        m, kind = k["m"], k["kind"]
        signed = F.when(m["minus"] | (m["x"]["left"] == "("), -m["size"]).otherwise(m["size"])
        value = F.when(m["x"]["power"] != "", m["x"]["power"].try_cast("double")).when(kind == "percent", signed / 100).otherwise(signed)
        return F.struct(kind.alias("kind"), F.when(kind.isNotNull(), value).alias("value"), F.when(kind == "currency", k["unit"]).alias("unit"))

    t = clean(c)
    plain = F.struct(F.lit("number").alias("kind"), F.regexp_replace(t, ",", "").try_cast("double").alias("value"), F.lit(None).cast("string").alias("unit"))
    return F.when(t.rlike(PLAIN_NUMBER), plain).when(t.rlike(_NUMBER_LIKE), once(around(t), lambda x: once(marks(x), lambda m: once(told(m), valued))))


def number(c: Column) -> Column:
    """1,299 and (123) and 12% and $5 and 1e3; null for other text."""
    return number_parts(c)["value"]


def unit(c: Column) -> Column:
    """The currency code of a money text."""
    return number_parts(c)["unit"]


#: All layouts of dates in one pattern; a text fits one of them at most, so parts of the same sense can stand together.
_WORD = "(" + "|".join(f"{m}|{m[:3]}" if len(m) > 3 else m for m in MONTHS) + "|sept)"
_DATE = "(?i)^(?:" + "|".join([
    r"(\d{4})([-/])(\d{1,2})\2(\d{1,2})", r"(\d{1,2})([/.-])(\d{1,2})\6(\d{4}|\d{2})", rf"{_WORD}\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})",
    rf"(\d{{1,2}})[-\s]{_WORD}\.?[-\s,]+(\d{{4}}|\d{{2}})", rf"(\d{{4}})[-\s]{_WORD}[-\s](\d{{1,2}})",
    r"(\d{4})-(\d{1,2})-(\d{1,2})[T ](\d{1,2}):(\d{2})(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:?\d{2})?",
]) + ")$"
_PARTS = {"year": "$1$8$11$14$15$18", "month": "$3$19", "day": "$4$10$12$17$20", "a": "$5", "b": "$7", "word": "$9$13$16", "hour": "$21", "minute": "$22", "slash": "$2", "day_named": "$12", "year_named": "$15"}
_MARK = "\x01"
#: How any date begins, and days that need no calendar.
_DATE_LIKE = r"(?i)^(?:\d{1,4}[-/.\s](?:\d{1,2}[-/.]|[a-z]{3})|[a-z]{3,9}\.?\s+\d)"
_PLAIN_DATE = r"^(?:19|20|21)[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|1[0-9]|2[0-8])$"


def _dated(c: Column, then) -> Column:
    """``then`` of the parts of a date in text: numbers (month and day as written or, for names, looked up) and texts, all null for other text."""

    def numbers(p: Column) -> Column:
        text_of = {n: F.nullif(F.get(p, i + 1), F.lit("")) for i, n in enumerate(_PARTS)}
        number = lambda n: text_of[n].try_cast("int")
        year = F.when(F.length(text_of["year"]) == 2, number("year") + 2000).otherwise(number("year"))
        named = ((F.position(F.lower(F.substring(text_of["word"], 1, 3)), F.lit("".join(m[:3] for m in MONTHS))) + 2) / 3).cast("int")
        fields = [year.alias("y"), F.coalesce(number("month"), named).alias("m"), number("day").alias("d"), *[number(n).alias(n) for n in ("a", "b", "hour", "minute")], *[text_of[n].alias(n) for n in ("year", "word", "slash", "day_named", "year_named")]]
        return F.when(F.get(p, 0) == _MARK, F.struct(F.lower(F.get(p, 0)).alias("mark"), *fields))

    marked = F.regexp_replace(clean(c), _DATE, ";".join([_MARK, *_PARTS.values()]))
    return F.when(clean(c).rlike(_DATE_LIKE), once(F.split(marked, ";"), lambda p: once(numbers(p), then)))


def _day(x: Column, m: Column, d: Column) -> Column:
    """The date; null if there is no such day, or its year isn't one of ``YEARS``."""
    return F.when(x["y"].between(*YEARS), F.try_to_timestamp(F.concat_ws("-", x["y"].cast("string"), F.coalesce(m, F.lit(0)).cast("string"), F.coalesce(d, F.lit(0)).cast("string")), F.lit("yyyy-M-d")).cast("date"))


def _any_day(x: Column, day_first: bool | None) -> Column:
    first, last = _day(x, x["b"], x["a"]), _day(x, x["a"], x["b"])
    digits = first if day_first else last if day_first is not None else F.when(x["a"] > 12, first).when(x["b"] > 12, last)  # else nothing says which is which
    timely = x["hour"].isNull() | ((x["hour"] < 24) & (x["minute"] < 60))
    return F.when(x["a"].isNotNull(), digits).when(timely, _day(x, x["m"], x["d"]))


def date(c: Column, day_first: bool | None = None) -> Column:
    """The day that a text shows; digits-only ones by ``day_first`` or, if that is None, where just one reading is possible."""
    return _dated(c, lambda x: _any_day(x, day_first))


def datetime(c: Column, day_first: bool | None = None) -> Column:
    """The day and, if there is one, the time that a text shows; seconds and zones are read over."""
    return _dated(c, lambda x: _any_day(x, day_first).cast("timestamp_ntz") + F.make_dt_interval(mins=F.coalesce(x["hour"] * 60 + x["minute"], F.lit(0))))


def _evidence(x: Column) -> Column:
    return F.when((x["a"] > 12) & (x["b"] <= 12), True).when((x["b"] > 12) & (x["a"] <= 12), False)


def date_layout(c: Column) -> Column:
    """A label of how a text shows a date: yyyy-mm-dd, numeric (digits only), Mon d yyyy, d-Month-yy and so on; null for no date."""
    return date_signs(c)["layout"]


def date_signs(c: Column) -> Column:
    """layout, and way: whether the day is first in digits only (null where that can't be told)."""
    t = clean(c)

    def label(x: Column) -> Column:
        gap = F.when(t.contains("-"), "-").otherwise(" ")
        word = F.when((F.length(x["word"]) > 3) & (F.lower(x["word"]) != "sept"), "Month").otherwise("Mon")
        year = F.when(F.length(x["year"]) == 2, "yy").otherwise("yyyy")
        named = F.when(x["day_named"].isNotNull(), F.concat(F.lit("d"), gap, word, gap, year)).when(x["year_named"].isNotNull(), F.concat(F.lit("yyyy"), gap, word, gap, F.lit("dd"))).otherwise(F.concat(word, F.lit(" d yyyy")))
        shown = F.when(x["hour"].isNotNull(), "yyyy-mm-dd hh:mm").when(x["slash"] == "/", "yyyy/mm/dd").when(x["slash"] == "-", "yyyy-mm-dd").otherwise(named)
        either = F.coalesce(_day(x, x["b"], x["a"]), _day(x, x["a"], x["b"])).isNotNull()
        return F.when(x["a"].isNotNull(), F.when(either, "numeric")).when(_any_day(x, None).isNotNull(), shown)

    plain = F.struct(F.lit("yyyy-mm-dd").alias("layout"), F.lit(None).cast("boolean").alias("way"))
    return F.when(t.rlike(_PLAIN_DATE), plain).otherwise(_dated(c, lambda x: F.struct(label(x).alias("layout"), _evidence(x).alias("way"))))


def day_first_evidence(c: Column) -> Column:
    """True if the first part of a/b/yyyy can't be a month, false if the second can't be."""
    return _dated(c, _evidence)


def serial_date(serial: Column, system: int = 1900) -> Column:
    """A day number of a sheet as a date; the 1900 system has a 29 February 1900 that never was."""
    day = F.floor(serial).cast("int")
    if system == 1904:
        return F.date_add(F.lit("1970-01-01").cast("date"), day - 24107)
    return F.date_add(F.lit("1970-01-01").cast("date"), F.when(day < 60, day - 25568).otherwise(day - 25569))


def serial_datetime(serial: Column, system: int = 1900) -> Column:
    """A day number with its fraction as the time of day, to the millisecond."""
    seconds = F.round((serial - F.floor(serial)) * 86400, 3).cast("decimal(18,6)")
    return serial_date(serial, system).cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)


def _converted(df: DataFrame, c: str, kind: str, scale: int, day_first: bool | None, system: int) -> tuple[Column, Column, Column]:
    """Value, error code and whether a number was stored as text, of a column read as a kind."""
    cell, stored = F.col(f"`{c}`"), df.schema[c].dataType
    numeric, flag, never = isinstance(stored, T.NumericType), isinstance(stored, T.BooleanType), F.lit(False)
    misfit, none = F.lit("#VALUE!"), F.lit(None).cast("string")
    is_text = isinstance(stored, T.StringType)
    code = error_code(cell) if is_text else none
    if kind == "text":
        shown = text.display(cell, "number" if numeric else "bool" if flag else "text" if is_text else "date" if isinstance(stored, T.DateType) else "datetime")
        return F.when(~blank(shown, True) & code.isNull(), shown), code, never
    if kind == "boolean":
        value = cell if flag else F.when(F.lower(clean(cell)) == "true", True).when(F.lower(clean(cell)) == "false", False)
        left = ~blank(cell.cast("string"), True)
    elif kind in ("date", "datetime"):
        if isinstance(stored, T.DateType | T.TimestampNTZType | T.TimestampType):
            value = cell.cast("date" if kind == "date" else "timestamp_ntz")
        elif numeric:
            value = (serial_date if kind == "date" else serial_datetime)(cell.cast("double"), system)
        else:
            value = F.lit(None).cast("date" if kind == "date" else "timestamp_ntz") if flag else (date if kind == "date" else datetime)(cell, day_first)
        left = ~is_null_token(cell)
    else:
        if numeric:
            return cell.cast("double") / scale, none, never
        scaled = once(number_parts(cell), lambda x: F.when(x["kind"] == "percent", x["value"]).otherwise(x["value"] / scale))
        value = scaled if is_text else F.lit(None).cast("double")
        left = ~is_null_token(cell)
    failed = F.coalesce(code, F.when(value.isNull() & left, misfit))
    read = value.isNotNull() & code.isNull() if is_text and kind in ("number", "currency", "percent") else never
    return (F.when(code.isNull(), value) if is_text else value), failed, read


def load(
    df: DataFrame, kinds: dict[str, str], percent_scale: dict[str, int] | None = None, day_first: dict[str, bool] | None = None, date_system: int = 1900
) -> DataFrame:
    """A table of cells with typed columns: number, percent, currency, date, datetime, boolean or text.

    Cells are texts, or values of the column's type; numbers in a date column are days of ``date_system``.  Error codes
    are errors in any column.  A cell that doesn't fit becomes an error (#VALUE!).  Errors stand in a column beside.
    """
    out = []
    for c, kind in kinds.items():
        value, code, _ = _converted(df, c, kind, (percent_scale or {}).get(c, 1), (day_first or {}).get(c), date_system)
        out += [value.alias(c), code.alias(ERROR + c)]
    return df.select(*out)


def load_notes(
    df: DataFrame, kinds: dict[str, str], percent_scale: dict[str, int] | None = None, day_first: dict[str, bool] | None = None, date_system: int = 1900
) -> DataFrame:
    """column, text_numbers (stored as text and read as numbers), unreadable (cells that don't fit) of what ``load`` reads; one pass."""
    asked, names = [], []
    for i, (c, kind) in enumerate(kinds.items()):
        _, code, read = _converted(df, c, kind, (percent_scale or {}).get(c, 1), (day_first or {}).get(c), date_system)
        own = error_code(F.col(f"`{c}`")) if isinstance(df.schema[c].dataType, T.StringType) else F.lit(None)
        asked += [F.count_if(read).alias(f"t{i}"), F.count_if((code == "#VALUE!") & own.isNull()).alias(f"u{i}")]
        names.append(F.struct(F.lit(c).alias("column"), F.col(f"t{i}").alias("text_numbers"), F.col(f"u{i}").alias("unreadable")))
    return df.agg(*asked).select(F.explode(F.array(*names)).alias("x")).select("x.*")


def notes(counted: DataFrame) -> tuple[tuple[str, int], ...]:
    """What an entity says of its loading, from ``load_notes``."""
    text_numbers, unreadable = counted.agg(F.coalesce(F.sum("text_numbers"), F.lit(0)), F.coalesce(F.sum("unreadable"), F.lit(0))).first()
    return (("numbers stored as text were read as numbers", text_numbers), ("cells that don't fit their column count as #VALUE!", unreadable))


__all__ = ["date", "date_layout", "datetime", "day_first_evidence", "error_code", "load", "load_notes", "notes", "number", "number_parts", "serial_date", "serial_datetime", "unit"]
