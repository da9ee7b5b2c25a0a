"""What sheets tell about themselves: number formats, the date system, and tables that moved or changed.

Everything is column expressions and joins, so the cells of any number of
workbooks are looked at together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .cells import CURRENCY_UNITS, serial_date

SAME_HEADERS = 0.5  # share of headers that a table at its old place keeps at least


def _bare(format: Column) -> Column:
    """A number format without quoted text, escaped characters and blocks in brackets."""
    return F.regexp_replace(format, r'"[^"]*"|\\.|\[[^\]]*\]', "")


def _unit(sign: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in CURRENCY_UNITS.items() for x in pair])
    return known[F.lower(F.trim(sign))]


def format_unit(format: Column) -> Column:
    """The currency code of a number format such as $#,##0.00 or [$EUR-407] 0, else null."""
    block = F.regexp_extract(format, r"\[\$([^\]-]+)", 1)
    return F.coalesce(_unit(block), _unit(F.regexp_extract(_bare(format), r"(US\$|[$₹€£¥])", 1)))


def format_class(format: Column) -> Column:
    """general, number, percent, currency, text, date or datetime: what cells of a number format hold."""
    bare = _bare(format)
    day, clock = bare.rlike("(?i)[dy]|m{3,}"), bare.rlike("(?i)[hs]|am/pm")
    return (
        F.when(format.isNull() | format.isin("", "General"), "general").when(format == "@", "text").when(format_unit(format).isNotNull(), "currency")
        .when(bare.contains("%"), "percent").when(clock, "datetime").when(day, "date").when(bare.rlike("[0#?]"), "number").otherwise("general")
    )


def _agrees(serial: Column, system: int, text: Column, format: Column) -> Column:
    """Whether a shown date can be the day of ``serial``: by its year, and by its day of the month if it is shown."""
    day = serial_date(serial, system)
    never = (F.floor(serial) == 60) & F.lit(system == 1900)  # 29 February 1900
    year, month_day = F.when(never, 1900).otherwise(F.year(day)), F.when(never, 29).otherwise(F.dayofmonth(day))
    numbers = F.regexp_extract_all(text, F.lit(r"(\d+)"), 1)
    full, short = F.filter(numbers, lambda t: F.length(t) == 4), F.transform(F.filter(numbers, lambda t: F.length(t) <= 2), lambda t: t.cast("int"))
    bare = F.lower(_bare(format))
    right_year = F.when(F.size(full) > 0, F.array_contains(full, year.cast("string"))).when(bare.contains("yy"), F.array_contains(short, (year % 100).cast("int"))).otherwise(True)
    right_day = ~bare.rlike("(^|[^d])d{1,2}([^d]|$)") | F.array_contains(short, month_day.cast("int"))
    return right_year & right_day


def date_systems(probes: DataFrame) -> DataFrame:
    """book, system (1900, 1904 or unknown) and telling: how many of its dates tell the systems apart.

    ``probes``: book, serial, text (as shown), format.  The two systems put a day four
    years apart.  Blank texts and serials below 1 say nothing; cells that disagree make it unknown.
    """
    finite = F.col("serial").isNotNull() & (F.col("serial") >= 1) & (F.col("serial") < 3_000_000)
    of = lambda system: _agrees(F.when(finite, F.col("serial")), system, F.col("text"), F.col("format"))
    read = probes.withColumn("_says", finite & F.coalesce(F.trim("text") != "", F.lit(False)))
    read = read.select("book", *[(F.col("_says") & F.coalesce(of(s), F.lit(False))).alias(f"_{s}") for s in (1900, 1904)])
    seen = read.groupBy("book").agg(F.count_if(F.expr("_1900 and not _1904")).alias("a"), F.count_if(F.expr("_1904 and not _1900")).alias("b"))
    system = F.when((F.col("a") > 0) & (F.col("b") == 0), "1900").when((F.col("b") > 0) & (F.col("a") == 0), "1904").otherwise("unknown")
    return seen.select("book", system.alias("system"), (F.col("a") + F.col("b")).alias("telling"))


def _folded(headers: Column) -> Column:
    return F.transform(headers, lambda h: F.lower(F.trim(h)))


def carry_ids(found: DataFrame, before: DataFrame) -> DataFrame:
    """``found`` with id: that of the same table in ``before``, else a new one of its place.

    Both: sheet, header_row, first_col, headers (array); ``before`` also has id.  A table is
    the same if its headers are those of one table of its sheet, wherever it is now; failing that,
    if it is at its old place with at least half of its headers.
    """
    place = ["sheet", "header_row", "first_col"]
    now, old = found.withColumn("_sig", _folded(F.col("headers"))), before.select("id", *place, _folded(F.col("headers")).alias("_sig"))
    alone = old.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("sheet", "_sig"))).where("_n = 1").select("sheet", "_sig", F.col("id").alias("_moved"))
    first = F.row_number().over(Window.partitionBy("sheet", "_sig").orderBy("header_row", "first_col")) == 1
    now = now.withColumn("_first", first).join(alone, ["sheet", "_sig"], "left").withColumn("_moved", F.when(F.col("_first"), F.col("_moved"))).drop("_first")
    left = old.join(now.select(F.col("_moved").alias("id")).where("id is not null"), "id", "left_anti")
    left = left.groupBy(*place).agg(F.min_by("_sig", "id").alias("_was"), F.min("id").alias("_stayed"))
    now = now.join(left, place, "left")
    shared = F.size(F.filter("_sig", lambda h: F.array_contains("_was", h))) / F.greatest(F.size("_sig"), F.size("_was"), F.lit(1))
    kept = F.coalesce("_moved", F.when(shared >= SAME_HEADERS, F.col("_stayed")))
    base = F.concat_ws(":", F.lit("r"), "sheet", F.concat(F.lit("R"), F.col("header_row").cast("string"), F.lit("C"), F.col("first_col").cast("string")))
    named = now.withColumn("_kept", kept).withColumn("_base", base)
    taken = named.where("_kept is not null").groupBy(F.col("_kept").alias("_base")).agg(F.lit(True).alias("_taken"))
    fresh = F.when(F.col("_taken"), F.concat("_base", F.lit("~2"))).otherwise(F.col("_base"))
    return named.join(taken, "_base", "left").select(F.coalesce("_kept", fresh).alias("id"), *found.columns)


def renamed_columns(before: DataFrame, after: DataFrame) -> DataFrame:
    """id, position, was, now: headers of the same table that changed at their place, the old one being gone and the new one new.

    Both: id, headers (array).
    """
    pairs = before.select("id", F.col("headers").alias("a")).join(after.select("id", F.col("headers").alias("b")), "id")
    both = pairs.select("id", _folded(F.col("a")).alias("ka"), _folded(F.col("b")).alias("kb"), F.posexplode(F.arrays_zip("a", "b")).alias("position", "x"))
    was, now = F.lower(F.trim("x.a")), F.lower(F.trim("x.b"))
    fresh = ~F.array_contains("kb", was) & ~F.array_contains("ka", now)
    return both.where(fresh).select("id", "position", F.col("x.a").alias("was"), F.col("x.b").alias("now"))


__all__ = ["carry_ids", "date_systems", "format_class", "format_unit", "renamed_columns"]
