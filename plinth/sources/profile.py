"""Column profiles and join candidates.

All columns are profiled by one aggregation; exact distinct counts come from one
long table (column, value), grouped twice, so that no task holds the values of a
column and Spark needs no expansion by column.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import cells as rules
from . import cells, workbook

MAX_CATEGORIES, EXEMPLARS, EXEMPLAR_LENGTH = 50, 5, 64
#: Names of columns that hold percents or money (fixed words).
PERCENT_WORDS, MONEY_WORDS = ("pct", "percent", "percentage", "rate"), ("amount", "price", "cost", "revenue", "budget", "spend", "salary", "fee", "sales", "payment")


def percent_name(name: str) -> bool:
    return "%" in name or any(w in PERCENT_WORDS for w in re.split(r"[\s_\-()]+", name.lower()))


def money_name(name: str) -> bool:
    return any(w in name.lower() for w in MONEY_WORDS)


def _long(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value) of every cell that isn't blank; text by its key."""
    keyed = []
    for c in columns:
        text = isinstance(df.schema[c].dataType, T.StringType)
        keyed.append(F.struct(F.lit(c).alias("column"), rules.key(F.col(f"`{c}`"), text).cast("string").alias("value")))
    return df.select(F.explode(F.array(*keyed)).alias("x")).select("x.column", "x.value").where("value is not null")


def distinct_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n): how often each value occurs."""
    return _long(df, columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def _typed(df: DataFrame, c: str) -> Column:
    """A cell as text if it is neither a null nor an error."""
    cell = F.col(f"`{c}`")
    if isinstance(df.schema[c].dataType, T.StringType):
        return F.when(~cells.is_null_token(cell) & cells.error_code(cell).isNull(), F.lower(cells.clean(cell)))
    whole = isinstance(df.schema[c].dataType, T.FractionalType)
    shown = F.when(cell == F.floor(cell.cast("double")), cell.cast("decimal(38,0)").cast("string")).otherwise(cell.cast("string")) if whole else cell.cast("string")
    return F.lower(shown)


def typed_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n): how often each value occurs that is neither a null nor an error."""
    keyed = [F.struct(F.lit(c).alias("column"), _typed(df, c).alias("value")) for c in columns]
    rows = df.select(F.explode(F.array(*keyed)).alias("x")).select("x.column", "x.value").where("value is not null")
    return rows.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def _fraction(df: DataFrame, columns: list[str]) -> Column:
    """The columns that hold a number with a fraction."""
    some = [F.when(F.max(F.col(f"`{c}`").cast("double") != F.floor(F.col(f"`{c}`").cast("double"))), F.lit(c)) for c in columns if isinstance(df.schema[c].dataType, T.FractionalType)]
    return F.array_compact(F.array(*some)) if some else F.array().cast("array<string>")


def profile(df: DataFrame) -> DataFrame:
    """column, type, rows, nulls, errors, distinct, categorical, key (a candidate) of each column of a typed table.

    A key has two values at least, no nulls, no errors, no repeats, and is text or whole numbers.
    """
    columns = [f.name for f in df.schema if not f.name.startswith("__") and isinstance(f.dataType, T.AtomicType)]
    counts = typed_values(df, columns).groupBy("column").agg(F.count(F.lit(1)).alias("distinct"), F.sum("n").alias("typed"))
    texts = [c for c in columns if isinstance(df.schema[c].dataType, T.StringType)]
    wrong = [F.count_if(cells.error_code(F.col(f"`{c}`")).isNotNull()).alias(f"e{i}") for i, c in enumerate(texts)]
    rows = df.agg(F.count(F.lit(1)).alias("rows"), _fraction(df, columns).alias("fractions"), *wrong)
    errors = {c: F.col(f"e{i}") for i, c in enumerate(texts)}
    types = [F.struct(F.lit(c).alias("column"), F.lit(df.schema[c].dataType.simpleString()).alias("type"), F.lit(isinstance(df.schema[c].dataType, T.NumericType)).alias("number"), errors.get(c, F.lit(0).cast("long")).alias("errors")) for c in columns]
    named = rows.select("rows", "fractions", F.explode(F.array(*types)).alias("x")).select("x.*", "rows", "fractions")
    joined = named.join(counts, "column", "left").fillna(0, ["distinct", "typed"])
    is_text = F.col("type") == "string"
    whole = F.col("number") & ~F.array_contains("fractions", F.col("column"))
    return joined.select(
        "column", "type", "rows", (F.col("rows") - F.col("typed") - F.col("errors")).alias("nulls"), "errors", "distinct",
        (is_text & (F.col("distinct") <= MAX_CATEGORIES) & (F.col("distinct") <= F.greatest(F.lit(2.0), 0.6 * F.col("typed")))).alias("categorical"),
        ((is_text | whole) & (F.col("typed") >= 2) & (F.col("typed") == F.col("rows")) & (F.col("distinct") == F.col("typed"))).alias("key"), whole.alias("whole"),
    )


def cell_class(c: Column) -> Column:
    """null, error, boolean, percent, currency, number, date, datetime or string, of a text cell."""
    return _class(_word_class(c), cells.number_parts(c)["kind"], cells.date_layout(c))


def text_class(c: Column) -> Column:
    """Whether a cell's class is string.  Only a text with a digit can be a number or a date."""
    plain = cells.clean(c).rlike(cells.PLAIN_NUMBER)
    return _word_class(c).isNull() & ~plain & (~c.rlike("[0-9]") | (cells.number_parts(c)["kind"].isNull() & cells.date_layout(c).isNull()))


def _word_class(c: Column) -> Column:
    return F.when(cells.error_code(c).isNotNull(), "error").when(cells.is_null_token(c), "null").when(F.lower(cells.clean(c)).isin("true", "false"), "boolean")


def _class(word: Column, number: Column, layout: Column) -> Column:
    return F.coalesce(word, number, rules.once(layout, lambda x: F.when(x == "yyyy-mm-dd hh:mm", "datetime").when(x.isNotNull(), "date")), F.lit("string"))


CLASSES = ("null", "error", "boolean", "percent", "currency", "number", "date", "datetime", "string")


def _plain_class(df: DataFrame, c: str, format_kind: str) -> Column:
    """The class of each cell of a column that isn't text, by its type and the column's number format."""
    kind, cell = df.schema[c].dataType, F.col(f"`{c}`")
    if isinstance(kind, T.NumericType):
        own = format_kind if format_kind in ("percent", "currency", "date", "datetime") else "number"
    else:
        own = "boolean" if isinstance(kind, T.BooleanType) else "date" if isinstance(kind, T.DateType) else "datetime"
    return F.when(cell.isNull(), "null").otherwise(own)


def infer(df: DataFrame, formats: dict[str, str] | None = None, formulas: dict[str, float] | None = None) -> list[dict]:
    """What kind each column of an untyped table is, with its flags and warnings; texts are counted first and each is read once.

    ``formats``: number formats of columns; ``formulas``: the share of a column's cells that are computed.  Cells are
    texts, or values of the column's type.
    """
    formats, asked = formats or {}, []
    spark, told = df.sparkSession, {c: ("general", None) for c in df.columns}
    if formats:
        said = spark.range(1).select(*[x for f in formats.values() for x in (workbook.format_class(F.lit(f)), workbook.format_unit(F.lit(f)))]).first()
        told |= {c: (said[2 * i], said[2 * i + 1]) for i, c in enumerate(formats)}
    number = {c: i for i, c in enumerate(df.columns)}
    texts = [c for c in df.columns if isinstance(df.schema[c].dataType, T.StringType)]
    plain = [c for c in df.columns if c not in texts]
    none_yet = {k: [] if k == "layouts" else None if k in ("min", "max") else 0 for k in _COUNTED}
    seen, distinct = {c: dict(none_yet) for c in df.columns}, {}
    if texts:  # each text is read once, however often it occurs
        keyed = [F.struct(F.lit(number[c]).alias("at"), _text_key(F.col(f"`{c}`")).alias("value")) for c in texts]
        counted = df.select(F.explode(F.array(*keyed)).alias("x")).select("x.at", "x.value").groupBy("at", "value").agg(F.count(F.lit(1)).alias("n"))
        cell, code = F.col("value"), F.col("value").isin(*cells.ERROR_CODES)
        word = F.when(code, "error").when(cell.isin(*cells.NULL_TOKENS), "null").when(cell.isin("true", "false"), "boolean")
        said = counted.select("at", "n", word.alias("word"), F.when(word.isNull(), cells.number_parts(cell)).alias("p"), F.when(word.isNull(), cells.date_signs(cell)).alias("d"))
        said = said.select("at", "n", "word", "p.*", "d.*").withColumn("class", F.coalesce("word", "kind", F.when(F.col("layout") == "yyyy-mm-dd hh:mm", "datetime").when(F.col("layout").isNotNull(), "date"), F.lit("string")))
        for r in said.groupBy("at").agg(*_counts(F.col("class"), F.col("value"), F.col("layout"), F.col("unit"), F.col("way"), F.col("n"))).collect():
            seen[df.columns[r["at"]]] = r.asDict()
            distinct[df.columns[r["at"]]] = r["distinct"]
    if plain:
        asked = []
        for c in plain:
            cell, none = F.col(f"`{c}`"), F.lit(None).cast("string")
            value = (cell if isinstance(df.schema[c].dataType, T.NumericType) else F.lit(None)).cast("double")
            asked += [x.alias(f"p{number[c]}_{k}") for k, x in zip(_COUNTED, _counts(_plain_class(df, c, told[c][0]), value, none, none, none.cast("boolean"), F.lit(1)), strict=True)]
        for k, v in df.agg(*asked).first().asDict().items():
            i, name = k[1:].split("_", 1)
            seen[df.columns[int(i)]][name] = none_yet[name] if v is None else v
        distinct |= {r["column"]: r["distinct"] for r in typed_values(df, plain).groupBy("column").agg(F.count(F.lit(1)).alias("distinct")).collect()}
    return [_inferred(df, c, seen[c], seen[c]["rows"], distinct.get(c, 0), told[c], formats.get(c), (formulas or {}).get(c, 0.0)) for c in df.columns]


def _text_key(cell: Column) -> Column:
    """A text by which cells say the same: lower-cased and without white space around it, an error code in upper case, a null as empty."""
    t = cells.clean(cell)
    return F.coalesce(F.when(F.upper(t).isin(*cells.ERROR_CODES), F.upper(t)).otherwise(F.lower(t)), F.lit(""))


def _counts(kind: Column, value: Column, layout: Column, units: Column, way: Column, n: Column) -> list[Column]:
    """What is counted of a column's cells (or of its distinct texts, each ``n`` times); in the order of ``_COUNTED``."""
    dated, counted = kind.isin("date", "datetime"), F.when(kind.isin("number", "percent", "currency"), value)
    times = lambda p: F.coalesce(F.sum(F.when(p, n)), F.lit(0))
    found = [F.sum(n), F.count_if(~kind.isin("null", "error")), *[times(kind == k) for k in CLASSES], times(dated & way), times(dated & ~way), times(dated & (layout == "numeric") & way.isNull())]
    found += [F.collect_set(F.when(dated, layout)), F.min(counted), F.max(counted), times(counted != F.floor(counted)), *[times(units == u) for u in UNITS]]
    return [x.alias(k) for k, x in zip(_COUNTED, found, strict=True)]


UNITS = tuple(dict.fromkeys(cells.CURRENCY_UNITS.values()))
_COUNTED = ("rows", "distinct", *CLASSES, "day", "month", "either", "layouts", "min", "max", "fractions", *UNITS)


def _inferred(df: DataFrame, c: str, n: dict, rows: int, few: int, told: tuple[str, str | None], format: str | None, computed: float) -> dict:
    typed, numeric, dates = rows - n["null"] - n["error"], n["percent"] + n["currency"] + n["number"], n["date"] + n["datetime"]
    is_text = isinstance(df.schema[c].dataType, T.StringType)
    unit = scale = None
    warnings = []
    if not typed:
        kind = "empty"
    elif dates >= 0.8 * typed:
        kind = "datetime" if n["datetime"] and n["datetime"] >= n["date"] else "date"
        if n["day"] and n["month"]:
            warnings.append("some dates have the day first and some the month")
        elif n["either"] and not n["day"] and not n["month"]:
            warnings.append("dates could have the day or the month first")
        if len(n["layouts"]) > 1:
            warnings.append("dates in several layouts")
        if typed > dates:
            warnings.append("values that are no dates")
    elif n["boolean"] >= 0.9 * typed:
        kind = "boolean"
    elif numeric >= 0.8 * typed:
        if 2 * n["percent"] >= numeric:
            kind, scale = "percent", 1
        elif percent_name(c) and n["min"] >= 0 and n["max"] <= 100:
            kind, scale = "percent", 1 if n["max"] <= 1 else 100
        elif 2 * n["currency"] >= numeric:
            most = max(n[u] for u in UNITS)
            kind, unit = "currency", next(u for u in UNITS if n[u] == most) if most else told[1]
        elif money_name(c):
            kind, unit = "currency", told[1]
            if unit is None:
                warnings.append("money without a unit")
        else:
            kind = "number"
        if n["currency"] and 2 * n["currency"] < numeric:
            warnings.append("currency signs on a few values")
        if typed > numeric:
            warnings.append("values that are no numbers")
    else:
        kind = "categorical" if few <= MAX_CATEGORIES and few <= max(2, 0.6 * typed) else "string"
        if dates and dates >= 0.2 * typed:
            warnings.append("dates among text")
    as_text = kind in ("number", "currency", "percent") and is_text and format == "@"
    warnings += ["error cells"] * (n["error"] > 0) + ["numbers stored as text"] * as_text
    label = "dd/mm and mm/dd" if n["day"] and n["month"] else "dd/mm" if n["day"] else "mm/dd" if n["month"] else "dd/mm or mm/dd"
    key = typed >= 2 and not n["null"] and not n["error"] and few == typed and (kind in ("string", "categorical") or (kind == "number" and not n["fractions"]))
    return {
        "column": c, "kind": kind, "rows": rows, "null_rate": round((n["null"] + n["error"]) / rows, 4) if rows else 0.0, "distinct": few, "unit": unit, "percent_scale": scale,
        "day_first": (n["day"] > 0 if bool(n["day"]) != bool(n["month"]) else None) if kind in ("date", "datetime") else None,
        "mixed_date_order": kind in ("date", "datetime") and n["day"] > 0 and n["month"] > 0,
        "date_formats": sorted(label if f == "numeric" else f for f in n["layouts"]) if kind in ("date", "datetime") else None,
        "may_contain_errors": n["error"] > 0, "numbers_as_text": as_text, "formula": computed >= 0.5, "key": key, "warnings": warnings,
    }


def exemplars(df: DataFrame) -> DataFrame:
    """(column, values): a few short values of each column."""
    columns = [f.name for f in df.schema if isinstance(f.dataType, T.AtomicType)]
    values = distinct_values(df, columns).where(F.length("value") <= EXEMPLAR_LENGTH)
    ranked = values.withColumn("r", F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))).where(F.col("r") <= EXEMPLARS)
    return ranked.groupBy("column").agg(F.sort_array(F.collect_list("value")).alias("values"))


def _tokens(name: Column) -> Column:
    return F.filter(F.split(F.lower(name), "[^a-z0-9]+"), lambda t: (F.length(t) > 1) & (t != "id"))


_BITS = 63  # of a long, without its sign


def _about(name: str, df: DataFrame, columns: list[str], number: dict[tuple[str, str], int]) -> DataFrame:
    """table, id (its number), column, rows, typed (neither nulls nor errors), text, fits (text or whole numbers) of each column; one pass."""
    fractions = _fraction(df, columns).alias("fractions")
    rows = df.agg(F.count(F.lit(1)).alias("rows"), fractions, *[F.count(_filled(df, c)).alias(f"t{i}") for i, c in enumerate(columns)])
    each = [F.struct(F.lit(number[name, c]).alias("id"), F.lit(c).alias("column"), F.col(f"t{i}").alias("typed"), F.lit(isinstance(df.schema[c].dataType, T.StringType)).alias("text"), (~F.array_contains("fractions", c)).alias("fits")) for i, c in enumerate(columns)]
    return rows.select(F.lit(name).alias("table"), "rows", F.explode(F.array(*each)).alias("x")).select("table", "rows", "x.*")


def _filled(df: DataFrame, c: str) -> Column:
    """Something if ``_typed`` is, without making the text."""
    cell = F.col(f"`{c}`")
    if not isinstance(df.schema[c].dataType, T.StringType):
        return cell
    return F.when(~cells.is_null_token(cell) & cells.error_code(cell).isNull(), True)


def _shared(tables: dict[str, DataFrame], columns: dict[str, list[str]], number: dict[tuple[str, str], int]) -> DataFrame:
    """(ids, n): how many distinct values lie in just these columns, by their numbers; text and numbers apart.

    A value's columns are bits, put together by one hash aggregation over all tables.  Columns of fractions are left
    out before their values are made.
    """
    words, long = -(-len(number) // _BITS), None
    for name, df in tables.items():
        parts = [c for c in columns[name] if isinstance(df.schema[c].dataType, T.FractionalType)]
        if parts:
            df = df.crossJoin(F.broadcast(df.agg(_fraction(df, parts).alias("__fractions"))))
        keyed = []
        for c in columns[name]:
            text, at = isinstance(df.schema[c].dataType, T.StringType), number[name, c]
            value = F.when(~F.array_contains("__fractions", c), _typed(df, c)) if c in parts else _typed(df, c)
            bits = [F.lit(1 << at % _BITS if at // _BITS == w else 0).cast("long").alias(f"b{w}") for w in range(words)]
            keyed.append(F.struct(F.lit(text).alias("text"), value.alias("value"), *bits))
        part = df.select(F.explode(F.array(*keyed)).alias("x")).select("x.*").where("value is not null")
        long = part if long is None else long.unionByName(part)
    masks = [f"b{w}" for w in range(words)]
    sets = long.groupBy("text", "value").agg(*[F.bit_or(b).alias(b) for b in masks]).groupBy(*masks).agg(F.count(F.lit(1)).alias("n"))
    held = [F.when(F.col(masks[i // _BITS]).bitwiseAND(F.lit(1 << i % _BITS).cast("long")) != 0, F.lit(i)) for i in number.values()]
    return sets.select(F.array_compact(F.array(*held)).alias("ids"), "n")


def join_candidates(tables: dict[str, DataFrame], least: float = 0.8, most: int = 50) -> DataFrame:
    """from_table, from_column, to_table, to_column, cardinality, overlap, confidence: columns whose values lie in a key of another table.

    All columns of text and of whole numbers go into one long table, in which each value is grouped once with the columns that
    it lies in; few sets of columns are left, and pairs are counted over these.  Both sides have two values at least.  Numbers
    need related names (a word in common); texts with unrelated names count for 0.9.  Of a pair that fits both ways the surer
    one is kept.
    """
    columns = {name: [f.name for f in df.schema if isinstance(f.dataType, T.StringType | T.NumericType) and not f.name.startswith("__")] for name, df in tables.items()}
    columns = {name: found for name, found in columns.items() if found}
    tables = {name: tables[name] for name in columns}
    number = {(name, c): i for i, (name, c) in enumerate((name, c) for name, found in columns.items() for c in found)}
    about = None
    for name, df in tables.items():
        found = _about(name, df, columns[name], number)
        about = found if about is None else about.unionByName(found)
    sets = _shared(tables, columns, number).select("n", F.explode("ids").alias("from"), F.col("ids").alias("others"))
    met = sets.select("n", "from", F.explode("others").alias("to")).groupBy("from", "to").agg(F.sum("n").alias("common"))
    about = about.where("fits").join(met.where("from = to").select(F.col("from").alias("id"), F.col("common").alias("distinct")), "id").where("distinct >= 2")
    about = about.withColumn("key", (F.col("typed") == F.col("rows")) & (F.col("distinct") == F.col("typed")))
    about = about.withColumns({"tokens": _tokens(F.col("column")), "plain": F.regexp_replace(F.lower("column"), "[^a-z0-9]", "")})
    side = lambda way: about.select(F.col("id").alias(way), *[F.col(c).alias(f"{way}_{c}") for c in ("table", "column", "text", "distinct", "key", "tokens", "plain")])  # noqa: E731  one row a column
    related = F.arrays_overlap("from_tokens", "to_tokens") | (F.col("from_plain") == F.col("to_plain"))
    pairs = met.join(side("from"), "from").join(side("to").where("to_key"), "to").where((F.col("from_table") != F.col("to_table")) & (F.col("from_text") == F.col("to_text")) & (F.col("from_text") | related))
    counted = pairs.withColumn("related", related)
    overlap = F.col("common") / F.col("from_distinct")
    confidence = overlap * (0.6 + 0.4 * F.least(F.lit(1.0), F.col("from_distinct") / 5)) * F.when(F.col("related"), 1.0).otherwise(0.9)
    out = counted.withColumns({"overlap": F.round(overlap, 2), "confidence": F.round(confidence, 2)}).where(overlap >= least)
    ends = F.array_sort(F.array(F.concat_ws(".", "from_table", "from_column"), F.concat_ws(".", "to_table", "to_column")))
    order = [F.desc("confidence"), "from_table", "from_column", "to_table", "to_column"]
    once = out.withColumn("_nth", F.row_number().over(Window.partitionBy(ends).orderBy(*order))).where("_nth = 1")
    cardinality = F.when(F.col("from_key"), "one-to-one").otherwise("many-to-one")
    return once.select("from_table", "from_column", "to_table", "to_column", cardinality.alias("cardinality"), "overlap", "confidence").orderBy(*order).limit(most)
