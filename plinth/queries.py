"""The registered plans over the test tables, each with the SQL that must agree with it."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .model import Entity, Environment, Link, Metric, TemplateColumn, TimeDimension
from .plans.run import compile_plan, content_hash, preview
from .plans.write import Edit, Query, choose, col, given, joined, measure, total_of, value
from .sources import cells, profile, regions, workbook

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
LINKS = (
    Link("orders", "o_custkey", "customer", "c_custkey"), Link("customer", "c_custkey", "orders", "o_custkey"), Link("customer", "c_nationkey", "nation", "n_nationkey"),
    Link("nation", "n_regionkey", "region", "r_regionkey"), Link("lineitem", "l_orderkey", "orders", "o_orderkey"), Link("supplier", "s_nationkey", "nation", "n_nationkey"),
)
UNIQUE = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey"}


def environment(spark: SparkSession, sf_dir: str) -> Environment:
    entities = {t: Entity(t, spark.read.parquet(f"{sf_dir}/{t}.parquet"), unique=frozenset([UNIQUE[t]] if t in UNIQUE else [])) for t in TABLES}
    metrics = (Metric("Order Value", "orders", "sum", "o_totalprice"), Metric("Open Orders", "orders", "count", "*", (col("o_orderstatus") != "F").json))
    return Environment(entities, LINKS, metrics, (TimeDimension("order_date", "orders", "o_orderdate"),))


def rounded(df: DataFrame, places: int = 2) -> DataFrame:
    """Doubles to so many places, as sums depend on the order of rows in their last digits."""
    return df.select(*[F.round(F.col(f"`{f.name}`"), places).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`") for f in df.schema])


def _plan(plan: Query | Edit, params: dict | None = None, places: int = 2) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: rounded(compile_plan(plan.plan, environment(spark, sf_dir), params).df, places)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_NOTED = Query("orders").derive(note=choose((col("o_totalprice") < 100000, col("o_orderpriority"))))
_NOTE = "SELECT o_orderkey, note FROM (SELECT o_orderkey, CASE WHEN o_totalprice < 100000 THEN o_orderpriority END AS note FROM orders)"
_EVENTS = ("event_id", "event_type", "value")
_DATES = {"y": "year", "q": "quarter", "m": "month", "w": "isoWeek", "d": "day", "dow": "isoDayOfWeek"}
_SIZE = col("o_totalprice").bucket([50000, 150000, 250000], ["small", "Medium", "large", "huge"])
_BUCKET = "CASE WHEN o_totalprice < 50000 THEN 'small' WHEN o_totalprice < 150000 THEN 'Medium' WHEN o_totalprice < 250000 THEN 'large' ELSE 'huge' END"
_LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
_NET = col("l_extendedprice") * (1 - col("l_discount"))
_RATES = Query("lineitem").derive(r=col("l_tax") / col("l_discount"))


def _period(grain: str, current: str, prior: str, ranges: tuple[str, str, str, str], metric: str = "Order Value", name: str = "order_value"):
    a, z, c, y = (f"TIMESTAMP '{r}'" for r in ranges)
    now, before = f"o_orderdate >= {a} AND o_orderdate < {z}", f"o_orderdate >= {c} AND o_orderdate < {y}"
    money = metric == "Order Value"
    reduced, where = ("sum(o_totalprice)", "") if money else ("count(*)", "AND o_orderstatus IS DISTINCT FROM 'F'")
    shown = (lambda x: f"round({x}, 2)") if money else (lambda x: x)
    of = lambda when: f"SELECT o_orderpriority, {reduced} AS x FROM orders WHERE {when} {where} GROUP BY 1"
    sql = f"""
WITH c AS ({of(now)}), p AS ({of(before)})
SELECT o_orderpriority, {shown("c.x")} AS current_{name}, {shown("p.x")} AS prior_{name}, {shown("c.x - p.x")} AS delta, round(CASE WHEN p.x <> 0 THEN (c.x - p.x) / p.x END, 2) AS delta_pct
FROM c FULL JOIN p USING (o_orderpriority)"""
    return _plan(Query("orders").compare(metric, "order_date", grain, current, prior, "o_orderpriority")), sql


#: Columns of the tables by how they are stored, for SQL that goes over all of them.
COLUMNS = {
    "region": "r_regionkey:int r_name:string", "nation": "n_nationkey:int n_name:string n_regionkey:int", "customer": "c_custkey:bigint c_name:string c_nationkey:int c_acctbal:double c_mktsegment:string",
    "supplier": "s_suppkey:bigint s_name:string s_nationkey:int s_acctbal:double", "part": "p_partkey:bigint p_name:string p_brand:string p_type:string p_size:int p_retailprice:double",
    "orders": "o_orderkey:bigint o_custkey:bigint o_orderstatus:string o_totalprice:double o_orderdate:timestamp_ntz o_orderpriority:string",
    "lineitem": "l_orderkey:bigint l_partkey:bigint l_suppkey:bigint l_linenumber:int l_quantity:double l_extendedprice:double l_discount:double l_tax:double l_returnflag:string l_linestatus:string l_shipdate:timestamp_ntz",
    "events": "event_id:bigint ts:timestamp_ntz user_id:bigint event_type:string value:double props:string",
}
STORED = {t: [tuple(c.split(":")) for c in columns.split()] for t, columns in COLUMNS.items()}


def _shown(c: str, kind: str) -> str:
    return f"lower(trim({c}))" if kind == "string" else f"CASE WHEN {c} = floor({c}) THEN {c}::BIGINT::VARCHAR ELSE {c}::VARCHAR END" if kind == "double" else f"{c}::VARCHAR"


def _profile_sql(table: str) -> str:
    """By the rule: a key has two values or more, no nulls, no repeats, and is text or whole numbers."""
    def one(c: str, kind: str) -> str:
        few = f"count(DISTINCT {_shown(c, kind)})"
        whole = {"string": "true", "double": f"coalesce(bool_and({c} = floor({c})), true)", "int": "true", "bigint": "true"}.get(kind, "false")
        number = "true" if kind in ("int", "bigint") else whole if kind == "double" else "false"
        return (
            f"SELECT '{c}' AS \"column\", '{kind}' AS type, count(*) AS rows, count(*) - count({c}) AS nulls, 0::BIGINT AS errors, {few} AS \"distinct\", "
            f"{f'{few} <= 50 AND {few} <= greatest(2, 0.6 * count({c}))' if kind == 'string' else 'false'} AS categorical, {whole} AND count({c}) >= 2 AND count({c}) = count(*) AND {few} = count(*) AS key, {number} AS whole FROM {table}"
        )

    return "\nUNION ALL\n".join(one(c, k) for c, k in STORED[table])


def _joins_sql() -> str:
    """All pairs of columns by the rule for candidates, from one long table of distinct values."""
    usable = [(t, c, k) for t, columns in STORED.items() for c, k in columns if k in ("string", "int", "bigint", "double")]
    values = "\nUNION ALL ".join(f"SELECT DISTINCT '{t}' AS t, '{c}' AS c, {str(k == 'string').lower()} AS is_text, {_shown(c, k)} AS v FROM {t} WHERE {c} IS NOT NULL" for t, c, k in usable)
    sizes = "\nUNION ALL ".join(f"SELECT '{t}' AS t, '{c}' AS c, count(*) AS rows, count({c}) AS typed, {f'coalesce(bool_and({c} = floor({c})), true)' if k == 'double' else 'true'} AS fits FROM {t}" for t, c, k in usable)
    words = "list_filter(string_split_regex(lower({0}), '[^a-z0-9]+'), lambda x: length(x) > 1 AND x <> 'id')"
    plain = "regexp_replace(lower({0}), '[^a-z0-9]', '', 'g')"
    return f"""
WITH vals AS ({values}),
about AS (
  SELECT t, c, any_value(is_text) AS is_text, count(*) AS n, any_value(rows) = any_value(typed) AND count(*) = any_value(typed) AS key FROM vals JOIN ({sizes}) USING (t, c) WHERE fits GROUP BY t, c HAVING count(*) >= 2),
met AS (
  SELECT f.t AS from_table, f.c AS from_column, k.t AS to_table, k.c AS to_column, f.n, f.key, list_has_any({words.format("f.c")}, {words.format("k.c")}) OR {plain.format("f.c")} = {plain.format("k.c")} AS related, count(*) AS common
  FROM about f JOIN vals a ON a.t = f.t AND a.c = f.c JOIN vals b ON a.v = b.v JOIN about k ON k.t = b.t AND k.c = b.c WHERE k.key AND f.t <> k.t AND f.is_text = k.is_text GROUP BY ALL),
scored AS (
  SELECT *, round(common / n, 2) AS overlap, round(common / n * (0.6 + 0.4 * least(1.0, n / 5)) * CASE WHEN related THEN 1 ELSE 0.9 END, 2) AS confidence,
    greatest(from_table || '.' || from_column, to_table || '.' || to_column) AS hi, least(from_table || '.' || from_column, to_table || '.' || to_column) AS lo
  FROM met WHERE common / n >= 0.8 AND (related OR (SELECT is_text FROM about x WHERE x.t = from_table AND x.c = from_column))),
once AS (SELECT *, row_number() OVER (PARTITION BY hi, lo ORDER BY confidence DESC, from_table, from_column, to_table, to_column) AS nth FROM scored)
SELECT from_table, from_column, to_table, to_column, CASE WHEN key THEN 'one-to-one' ELSE 'many-to-one' END AS cardinality, overlap, confidence FROM once WHERE nth = 1
ORDER BY confidence DESC, from_table, from_column, to_table, to_column LIMIT 50"""


def _profile(table: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: profile.profile(_table(spark, sf_dir, table))


def _joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.join_candidates({t: _table(spark, sf_dir, t) for t in TABLES})


def _reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values to sheet text and back: grouped thousands, accounting negatives, day names of months."""
    rows = _table(spark, sf_dir, "orders")
    shown = F.format_number("o_totalprice", 2)
    as_text = rows.select(
        F.col("o_orderkey").cast("string").alias("o_orderkey"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("("), shown, F.lit(")"))).otherwise(F.concat(F.lit("$"), shown)).alias("price"),
        F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "d-MMM-yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"),
    )
    return rounded(cells.load(as_text, {"o_orderkey": "number", "price": "currency", "day": "date"}).select("o_orderkey", "price", "day"))


#: Spellings of a day, by the order's key; digits-only ones say nothing about their order unless the day is beyond 12.
_SPELLINGS = (
    ("date_format(o_orderdate, 'yyyy-MM-dd')", True), ("date_format(o_orderdate, 'yyyy/M/d')", True), ("date_format(o_orderdate, 'd-MMM-yyyy')", True), ("date_format(o_orderdate, 'MMM d, yyyy')", True),
    ("date_format(o_orderdate, 'MMMM d yyyy')", True), ("date_format(o_orderdate, 'd MMMM yyyy')", True), ("date_format(o_orderdate, 'yyyy-MMM-dd')", True), ("date_format(o_orderdate, 'M/d/yyyy')", False),
    ("date_format(o_orderdate, 'dd.MM.yyyy')", False), ("date_format(o_orderdate, 'yyyy-MM-dd') || ' 07:30'", True), ("date_format(o_orderdate, 'MMM d') || 'th, ' || year(o_orderdate)", True), ("'2001-02-31'", None), ("' \t'", None),
)


def _spelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days in all spellings, read as dates and with their time."""
    turn = "CASE o_orderkey % 13 " + " ".join(f"WHEN {i} THEN {x}" for i, (x, _) in enumerate(_SPELLINGS)) + " END"
    as_text = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("o_orderkey"), F.expr(turn).alias("day"), F.expr(turn).alias("at"))
    read = cells.load(as_text, {"o_orderkey": "number", "day": "date", "at": "datetime"})
    return read.select("o_orderkey", "day", "at", F.col("`__e$day`").alias("error"))


def _serials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day numbers of both date systems, with quarters of a day."""
    day = F.datediff("o_orderdate", F.lit("1970-01-01").cast("date")) + (F.col("o_orderkey") % 4) / 4
    numbers = _table(spark, sf_dir, "orders").select("o_orderkey", (day + 25569).alias("day"), (day + 25569).alias("at"))
    old = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), (day + 24107).alias("at_1904"))
    new = cells.load(numbers, {"o_orderkey": "number", "day": "date", "at": "datetime"}).select("o_orderkey", "day", "at")
    return new.join(cells.load(old, {"k": "number", "at_1904": "datetime"}, date_system=1904).select(F.col("k").alias("o_orderkey"), "at_1904"), "o_orderkey")


_MIXED = """CASE WHEN o_orderkey % 7 = 0 THEN '#n/a' WHEN o_orderkey % 7 = 1 THEN 'n/a' ELSE o_orderpriority END"""
_MIXED_KINDS = {"note": "text", "amount": "number", "flag": "boolean"}


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that don't fit their columns, and error codes in columns of text and of numbers."""
    amount = "CASE o_orderkey % 5 WHEN 0 THEN '#DIV/0!' WHEN 1 THEN o_orderstatus WHEN 2 THEN '-' ELSE ' ' || o_orderkey END"
    flag = "CASE o_orderkey % 4 WHEN 0 THEN 'TRUE' WHEN 1 THEN 'false' WHEN 2 THEN 'yes' END"
    return _table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{_MIXED} AS note", f"{amount} AS amount", f"{flag} AS flag")


def _errors_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    loaded = cells.load(_mixed(spark, sf_dir), {"o_orderkey": "number"} | _MIXED_KINDS)
    return loaded.select("o_orderkey", *_MIXED_KINDS, *[F.col(f"`__e${c}`").alias(f"{c}_error") for c in _MIXED_KINDS])


def _notes_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.load_notes(_mixed(spark, sf_dir), _MIXED_KINDS)


def _hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which changes of a table its hash tells: of one cell, of nulls that change places, of a name, of a type, of a row; not of order."""
    df = _table(spark, sf_dir, "orders").withColumns({"a": F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")), "b": F.lit(None).cast("string")})
    least = df.agg(F.min("o_orderkey")).first()[0]
    changed = {
        "order of rows": df.orderBy(F.desc("o_totalprice")), "one cell": df.withColumn("o_orderstatus", F.when(F.col("o_orderkey") == least, "?").otherwise(F.col("o_orderstatus"))),
        "null in another column": df.withColumns({"a": F.col("b"), "b": F.col("a")}), "name": df.withColumnRenamed("o_orderstatus", "status"), "type": df.withColumn("o_custkey", F.col("o_custkey").cast("int")),
        "one row less": df.where(F.col("o_orderkey") != least),
    }
    before = content_hash(df)
    told = [(what, content_hash(x) != before) for what, x in changed.items()]
    return df.agg(F.count(F.lit(1)).alias("rows")).crossJoin(F.broadcast(spark.createDataFrame(told, "change string, told boolean")))


def _skip_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums over quotients of which those by zero are errors, with error cells left out."""
    plan = _RATES.aggregate("l_returnflag", total=measure("sum", "r"), top=measure("max", "r"), n=measure("count", "r"))
    return rounded(compile_plan(plan.plan, environment(spark, sf_dir), exclude_error_cells=True).df)


def _issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a preview tells: error cells that a sum and a filter met, keys that repeat in a look-up, errors in the result, notes of loading."""
    env, found = environment(spark, sf_dir), []
    lines = env.entity("lineitem")
    repeats = replace(lines, unique=frozenset(["l_orderkey"]), notes=(("read over", 7),))
    tables = replace(env, entities={**env.entities, "lineitem": repeats})
    plans = {
        "sum": _RATES.aggregate("l_linestatus", total=measure("sum", "r")), "filter": _RATES.filter(col("r") > 1), "cells": _RATES.project("l_orderkey", "r"),
        "look-up": Query("orders").lookup("lineitem", "o_orderkey", "l_orderkey", "l_partkey"),
    }
    for name, plan in plans.items():
        shown = preview(compile_plan(plan.plan, tables), 3)
        found += [(name, shown.count, i.code, i.count, i.blocking) for i in shown.issues]
    return spark.createDataFrame(found, "plan string, rows long, code string, n long, blocking boolean")


def _template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in the columns of a template; its formula column is not written."""
    card = (TemplateColumn("No", "number"), TemplateColumn("Name"), TemplateColumn("Row #", formula=True), TemplateColumn("Segment"), TemplateColumn("Balance", "number"))
    env = replace(environment(spark, sf_dir), templates={"card": card})
    plan = Query("customer", mode="template", templateId="card").filter(col("c_acctbal") > 0).project(No="c_custkey", Name="c_name", Segment="c_mktsegment", Balance="c_acctbal")
    return rounded(compile_plan(plan.plan, env).df)


_AS_CELL = """CASE o_orderkey % 9 WHEN 0 THEN '$' || {price} WHEN 1 THEN {price} WHEN 2 THEN o_orderkey || '%' WHEN 3 THEN {day} WHEN 4 THEN 'TRUE'
WHEN 5 THEN 'n/a' WHEN 6 THEN '#div/0!' WHEN 7 THEN '0' || o_orderkey ELSE o_orderpriority END"""


def _classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as cells of all sorts, and what each is taken for."""
    cell = _AS_CELL.format(price="format_number(o_totalprice, 2)", day="date_format(o_orderdate, 'd-MMM-yyyy')")
    shown = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.expr(cell).alias("cell"))
    return shown.groupBy(profile.cell_class(F.col("cell")).alias("class")).agg(F.count(F.lit(1)).alias("cells"))


_TEXTS = {
    "o_orderkey": "o_orderkey::string", "o_totalprice": "'€' || format_number(o_totalprice, 2)", "o_orderdate": "date_format(o_orderdate, 'd/M/yyyy')", "o_orderpriority": "o_orderpriority", "discount_rate": "(o_orderkey % 101)::string",
    "growth_rate": "(o_orderkey % 501)::string", "seen_at": "date_format(o_orderdate, 'yyyy-MM-dd') || ' 07:30'", "open": "CASE WHEN o_orderstatus = 'O' THEN 'TRUE' ELSE 'false' END",
    "ref": "CASE WHEN o_orderkey % 50 = 0 THEN 'n/a' ELSE 'R' || o_orderkey END", "code": "'C' || o_orderkey", "balance": "CASE WHEN o_orderkey % 5 = 0 THEN '#REF!' ELSE o_orderkey::string END",
    "share": "(o_orderkey % 4 / 4)::string", "fee": "(o_orderkey % 9)::string",
}


def _kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the columns of orders are, judged by their texts alone."""
    as_text = _table(spark, sf_dir, "orders").selectExpr(*[f"{x} AS {c}" for c, x in _TEXTS.items()])
    found = [
        (x["column"], x["kind"], x["unit"], x["rows"], x["distinct"], x["day_first"], x["key"], x["percent_scale"], x["may_contain_errors"], x["null_rate"], ";".join(x["date_formats"] or []), ";".join(x["warnings"]))
        for x in profile.infer(as_text)
    ]
    return spark.createDataFrame(found, "column string, kind string, unit string, rows long, distinct long, day_first boolean, key boolean, scale int, errors boolean, null_rate double, formats string, warnings string")


def _kinds_sql() -> str:
    def one(c: str, kind: str, value: str, unit: str = "NULL", day_first: str = "NULL", key: str = "false", scale: str = "NULL", errors: str = "false", left: str = "0", formats: str = "", warnings: str = "") -> str:
        return f"SELECT '{c}' AS \"column\", '{kind}' AS kind, {unit} AS unit, count(*) AS rows, count(DISTINCT {value}) AS \"distinct\", {day_first}::BOOLEAN AS day_first, {key} AS key, {scale}::INT AS scale, {errors} AS errors, round({left}, 4)::DOUBLE AS null_rate, '{formats}' AS formats, '{warnings}' AS warnings FROM orders"

    unique = "count(DISTINCT o_orderkey) = count(*)"
    return "\nUNION ALL ".join([
        one("o_orderkey", "number", "o_orderkey", key=unique), one("o_totalprice", "currency", "format('{:,.2f}', round(o_totalprice, 2))", unit="'EUR'"), one("o_orderdate", "date", "o_orderdate", day_first="true", formats="dd/mm"),
        one("o_orderpriority", "categorical", "o_orderpriority"), one("discount_rate", "percent", "o_orderkey % 101", scale="100"), one("growth_rate", "number", "o_orderkey % 501"),
        one("seen_at", "datetime", "o_orderdate", formats="yyyy-mm-dd hh:mm"), one("open", "boolean", "o_orderstatus = ''O''".replace("''", "'")),
        one("ref", "string", "CASE WHEN o_orderkey % 50 <> 0 THEN o_orderkey END", left="count(*) FILTER (WHERE o_orderkey % 50 = 0) / count(*)"), one("code", "string", "o_orderkey", key=unique),
        one("balance", "number", "CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey END", errors="true", left="count(*) FILTER (WHERE o_orderkey % 5 = 0) / count(*)", warnings="error cells"),
        one("share", "number", "o_orderkey % 4"), one("fee", "currency", "o_orderkey % 9", warnings="money without a unit"),
    ])


def _exemplars(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = profile.exemplars(_table(spark, sf_dir, "part").drop("p_retailprice"))  # its texts differ between engines
    return found.select("column", F.array_join("values", ";").alias("values"))


def _exemplars_sql() -> str:
    values = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {f'lower({c})' if k == 'string' else f'{c}::VARCHAR'} AS v, count(*) AS n FROM part GROUP BY ALL" for c, k in STORED["part"] if k != "double")
    return f"""
WITH v AS ({values}), r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, v) AS k FROM v WHERE length(v) <= 64)
SELECT "column", string_agg(v, ';' ORDER BY v) AS "values" FROM r WHERE k <= 5 GROUP BY 1"""


def _workbook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sheet a customer: a title, a table of orders with their total, another one beside it, and one below with labels of
    groups, a repeated and a missing header."""
    orders = _table(spark, sf_dir, "orders")
    line = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) + 3
    cell = lambda row, place, shown: F.struct(row.cast("int").alias("row"), F.lit(place).alias("col"), shown.cast("string").alias("value"))
    wide = lambda row, first, *texts: F.array(*[cell(row, first + i, t) for i, t in enumerate(texts)])
    say = lambda *words: [F.lit(w) for w in words]
    sheet = F.col("o_custkey").cast("string").alias("sheet")
    data = orders.withColumn("line", line).select(sheet, F.explode(wide(F.col("line"), 1, F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.format_number("o_totalprice", 2))).alias("c"))
    per = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("s"), F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"))
    below = F.col("n") + 8
    around = F.concat(
        wide(F.lit(1), 1, *say("Orders")), wide(F.lit(3), 1, *say("Order", "Day", "Price")), wide(F.col("n") + 4, 1, F.lit("Total"), F.lit(" "), F.format_number("s", 2)),
        wide(F.lit(3), 5, *say("Key", "Value")), wide(F.lit(4), 5, F.lit("Customer"), F.col("o_custkey")), wide(F.lit(5), 5, F.lit("Count"), F.col("n")),
        wide(below, 2, *say("Half")), wide(below + 1, 1, *say("Day", "Orders", "orders")), *[wide(below + i, 1, F.date_format(d, "yyyy-MM-dd"), F.col("n"), F.col("n") * i, F.lit(i)) for i, d in ((2, "first"), (3, "last"))],
    )
    return data.unionByName(per.select(sheet, F.explode(around).alias("c"))).select("sheet", "c.*")


def _sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = regions.regions(_workbook(spark, sf_dir))
    return found.select("sheet", *[F.col(c).cast("long").alias(c) for c in ("region", "header_row", "header_rows", "first_row", "last_row", "first_col", "last_col", "rows", "skipped")])


def _headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.headers(_workbook(spark, sf_dir)).select("sheet", F.col("region").cast("long").alias("region"), F.col("col").cast("long").alias("col"), "name")


def _date_systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order days as day numbers of two systems beside what a sheet shows of them, by priority."""
    orders = _table(spark, sf_dir, "orders").withColumn("day", F.datediff("o_orderdate", F.lit("1970-01-01").cast("date")))
    early = F.col("o_orderpriority") < "3"
    probes = orders.select(
        F.col("o_orderpriority").alias("book"), (F.col("day") + F.when(early, 25569).otherwise(24107)).cast("double").alias("serial"),
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("text"), F.lit("dd/mm/yyyy").alias("format"),
    )
    return workbook.date_systems(probes)


def _carried(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of two scans, one for each customer: some moved, some with a new header, some all new."""
    rows, kind = _table(spark, sf_dir, "customer"), F.col("c_custkey") % 3
    names = F.array(F.lit("Key"), F.lit("Area"), F.col("c_name"))
    before = rows.select(F.concat(F.lit("t"), "c_custkey").alias("id"), F.col("c_name").alias("sheet"), F.lit(1).alias("header_row"), F.lit(1).alias("first_col"), names.alias("headers"))
    headers = F.when(kind == 0, F.transform(names, F.upper)).when(kind == 1, F.array(F.lit("Key"), F.lit("Region"), F.col("c_name"))).otherwise(F.array(F.lit("x"), F.lit("y")))
    after = rows.select(F.col("c_name").alias("sheet"), F.when(kind == 0, 7).otherwise(1).alias("header_row"), F.lit(1).alias("first_col"), headers.alias("headers"))
    kept = workbook.carry_ids(after, before)
    changed = workbook.renamed_columns(before, kept).select("id", F.concat_ws(">", "was", "now").alias("renamed"))
    return kept.join(changed, "id", "left").select("sheet", "id", "renamed")


def _text(name: str, pattern: str):
    return joined(col(name).shown(pattern))


PLANS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "filter_eq_ci": (_plan(Query("orders").filter(col("o_orderstatus") == "f")), "SELECT * FROM orders WHERE lower(o_orderstatus) = 'f'"),
    "filter_ne_keeps_blank": (_plan(_NOTED.filter(col("note") != "1-urgent").project("o_orderkey", "note")), f"{_NOTE} WHERE lower(note) IS DISTINCT FROM '1-urgent'"),
    "filter_lt": (_plan(Query("lineitem").filter(col("l_quantity") < 5)), "SELECT * FROM lineitem WHERE l_quantity < 5"),
    "filter_lte": (_plan(Query("lineitem").filter(col("l_quantity") <= 5)), "SELECT * FROM lineitem WHERE l_quantity <= 5"),
    "filter_gt": (_plan(Query("lineitem").filter(col("l_shipdate") > dt.date(2001, 1, 1))), "SELECT * FROM lineitem WHERE l_shipdate > DATE '2001-01-01'"),
    "filter_gte": (_plan(Query("lineitem").filter(col("l_shipdate") >= dt.date(2001, 1, 1))), "SELECT * FROM lineitem WHERE l_shipdate >= DATE '2001-01-01'"),
    "filter_in": (_plan(Query("customer").filter(col("c_mktsegment").among("building", "Machinery"))), "SELECT * FROM customer WHERE lower(c_mktsegment) IN ('building', 'machinery')"),
    "filter_not_in": (_plan(Query("customer").filter(col("c_mktsegment").outside("building", "Machinery"))), "SELECT * FROM customer WHERE lower(c_mktsegment) NOT IN ('building', 'machinery')"),
    "filter_in_dates": (_plan(Query("orders").filter(col("o_orderdate").among("1996-03-01", "1997-05-17", "1999-12-31"))), "SELECT * FROM orders WHERE o_orderdate IN (TIMESTAMP '1996-03-01', TIMESTAMP '1997-05-17', TIMESTAMP '1999-12-31')"),
    "filter_is_null": (_plan(_NOTED.filter(col("note").is_blank()).project("o_orderkey", "note")), f"{_NOTE} WHERE note IS NULL"),
    "filter_is_not_null": (_plan(_NOTED.filter(col("note").is_filled()).project("o_orderkey", "note")), f"{_NOTE} WHERE note IS NOT NULL"),
    "filter_and": (_plan(Query("events").filter((col("value") > 50) & (col("event_type") == "click")).project(*_EVENTS)), "SELECT event_id, event_type, round(value, 2) AS value FROM events WHERE value > 50 AND event_type = 'click'"),
    "filter_or": (_plan(Query("events").filter((col("value") > 90) | (col("event_type") == "click")).project(*_EVENTS)), "SELECT event_id, event_type, round(value, 2) AS value FROM events WHERE value > 90 OR event_type = 'click'"),
    "filter_not": (_plan(Query("events").filter(~((col("value") > 50) | (col("event_type") == "click"))).project(*_EVENTS)), "SELECT event_id, event_type, round(value, 2) AS value FROM events WHERE NOT (coalesce(value > 50, false) OR coalesce(event_type = 'click', false))"),
    "filter_col_col": (_plan(Query("part").derive(half=col("p_retailprice") / 40).filter(col("p_size") < col("half")).project("p_partkey", "p_size")), "SELECT p_partkey, p_size FROM part WHERE p_size < p_retailprice / 40"),
    "filter_param": (_plan(Query("orders").parameters(asOf="date").filter(col("o_orderdate") >= given("asOf")), {"asof": "2000-06-01"}), "SELECT * FROM orders WHERE o_orderdate >= DATE '2000-06-01'"),
    "derive_arith": (_plan(Query("lineitem").derive(net=_NET, gross=col("net") + col("net") * col("l_tax")).project(*_LINE, "net", "gross"), places=6),
        "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice * (1 - l_discount), 6) AS net, round(l_extendedprice * (1 - l_discount) + l_extendedprice * (1 - l_discount) * l_tax, 6) AS gross FROM lineitem"),
    "derive_ratio_pct_div0": (_plan(Query("lineitem").derive(r=col("l_tax").ratio(col("l_discount")), p=col("l_quantity").pct(col("l_discount") * 100)).project(*_LINE, "r", "p")),
        "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN l_discount = 0 THEN NULL ELSE l_tax / l_discount END, 2) AS r, round(CASE WHEN l_discount = 0 THEN NULL ELSE l_quantity / (l_discount * 100) END, 2) AS p FROM lineitem"),
    "derive_date_parts": (_plan(Query("lineitem").derive(**{n: col("l_shipdate").part(t) for n, t in _DATES.items()}).project(*_LINE, *_DATES)),
        "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, year(l_shipdate)::INT AS y, quarter(l_shipdate)::INT AS q, month(l_shipdate)::INT AS m, week(l_shipdate)::INT AS w, day(l_shipdate)::INT AS d, isodow(l_shipdate)::INT AS dow FROM lineitem"),
    "derive_bucket": (_plan(Query("orders").derive(size=_SIZE).project("o_orderkey", "size")), f"SELECT o_orderkey, {_BUCKET} AS size FROM orders"),
    "derive_coalesce_case": (_plan(_NOTED.derive(shown=col("note").or_else("dear"), state=choose((col("o_orderstatus") == "F", "final"), (col("o_orderstatus") == "O", "open"), otherwise="other")).project("o_orderkey", "shown", "state")),
        "SELECT o_orderkey, CASE WHEN o_totalprice < 100000 THEN o_orderpriority ELSE 'dear' END AS shown, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE 'other' END AS state FROM orders"),
    "agg_all_fns": (_plan(Query("lineitem").aggregate("l_returnflag", n=measure("count"), parts=measure("countDistinct", "l_partkey"), many=measure("countIf", "*", col("l_quantity") > 25), total=measure("sum", "l_extendedprice"), mean=measure("avg", "l_quantity"), first=measure("min", "l_shipdate"), top=measure("max", "l_discount"))),
        "SELECT l_returnflag, count(*) AS n, count(DISTINCT l_partkey) AS parts, count(*) FILTER (WHERE l_quantity > 25) AS many, round(sum(l_extendedprice), 2) AS total, round(avg(l_quantity), 2) AS mean, min(l_shipdate) AS first, round(max(l_discount), 2) AS top FROM lineitem GROUP BY l_returnflag"),
    "agg_filter_sort": (_plan(Query("lineitem").filter(col("l_quantity") > 5).aggregate("l_returnflag", "l_linestatus", total=measure("sum", "l_extendedprice"), parts=measure("countDistinct", "l_partkey")).sort("-total")),
        "SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice), 2) AS total, count(DISTINCT l_partkey) AS parts FROM lineitem WHERE l_quantity > 5 GROUP BY ALL"),
    "agg_where": (_plan(Query("lineitem").aggregate("l_linestatus", "l_returnflag", late=measure("sum", "l_quantity", col("l_shipdate") >= dt.date(2001, 10, 1)), cheap=measure("countIf", "*", col("l_extendedprice") < 1000), none=measure("avg", "l_tax", col("l_quantity") < 0), few=measure("countDistinct", "l_suppkey", col("l_quantity") < 2))),
        "SELECT l_linestatus, l_returnflag, round(sum(l_quantity) FILTER (WHERE l_shipdate >= DATE '2001-10-01'), 2) AS late, count(*) FILTER (WHERE l_extendedprice < 1000) AS cheap, round(avg(l_tax) FILTER (WHERE l_quantity < 0), 2) AS none, count(DISTINCT l_suppkey) FILTER (WHERE l_quantity < 2) AS few FROM lineitem GROUP BY ALL"),
    "agg_global_empty": (_plan(Query("orders").filter(col("o_totalprice") < -1).aggregate(n=measure("count"), total=measure("sum", "o_totalprice"))), "SELECT count(*) AS n, sum(o_totalprice) AS total FROM orders WHERE o_totalprice < -1"),
    "agg_distinct_keys": (_plan(Query("part").aggregate("p_brand", "p_type")), "SELECT DISTINCT p_brand, p_type FROM part"),
    "agg_sum_all_share": (_plan(Query("orders").aggregate("o_orderpriority", total=measure("sum", "o_totalprice")).derive(share=col("total").pct(total_of("total")))),
        "SELECT o_orderpriority, round(sum(o_totalprice), 2) AS total, round(sum(o_totalprice) / sum(sum(o_totalprice)) OVER (), 2) AS share FROM orders GROUP BY 1"),
    "sort_limit_topk": (_plan(Query("orders").sort("-o_totalprice", "o_orderkey").limit(10)), "SELECT * REPLACE (round(o_totalprice, 2) AS o_totalprice) FROM orders ORDER BY orders.o_totalprice DESC, o_orderkey LIMIT 10"),
    "filter_sort_limit": (_plan(Query("orders").filter(col("o_totalprice") > 100000).sort("o_orderdate", "o_orderkey").limit(25).project("o_orderkey", "o_orderdate")), "SELECT o_orderkey, o_orderdate FROM orders WHERE o_totalprice > 100000 ORDER BY o_orderdate, o_orderkey LIMIT 25"),
    "join_inner": (_plan(Query("orders").join("customer", "o_custkey", "c_custkey").project("o_orderkey", "c_name", "c_custkey")), "SELECT o_orderkey, c_name, c_custkey FROM orders JOIN customer ON o_custkey = c_custkey"),
    "join_left": (_plan(Query("customer").join("orders", "c_custkey", "o_custkey", "left").aggregate("c_custkey", n=measure("count", "o_orderkey"), total=measure("sum", "o_totalprice"))), "SELECT c_custkey, count(o_orderkey) AS n, round(sum(o_totalprice), 2) AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1"),
    "lookup_take": (_plan(Query("supplier").lookup("nation", "s_nationkey", "n_nationkey", "n_name")), "SELECT supplier.* REPLACE (round(s_acctbal, 2) AS s_acctbal), n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey"),
    "lookup_chain": (_plan(Query("customer").lookup("nation", "c_nationkey", "n_nationkey").lookup("region", "n_regionkey", "r_regionkey", "r_name").aggregate("r_name", n=measure("count"), balance=measure("sum", "c_acctbal"))),
        "SELECT r_name, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1"),
    "pivot_quarter": (_plan(Query("orders").derive(q=col("o_orderdate").part("quarter")).pivot(["o_orderpriority"], "q", "o_totalprice")),
        "SELECT o_orderpriority, " + ", ".join(f'round(sum(o_totalprice) FILTER (WHERE quarter(o_orderdate) = {q}), 2) AS "{q}"' for q in (1, 2, 3, 4)) + " FROM orders GROUP BY 1"),
    "period_compare_year": _period("year", "2000", "1999", ("2000-01-01", "2001-01-01", "1999-01-01", "2000-01-01")),
    "period_compare_quarter": _period("quarter", "2000-Q1", "1999-Q4", ("2000-01-01", "2000-04-01", "1999-10-01", "2000-01-01")),
    "period_compare_month": _period("month", "2001-08", "2001-07", ("2001-08-01", "2001-09-01", "2001-07-01", "2001-08-01"), "Open Orders", "open_orders"),
    "period_compare_week": _period("week", "1998-W10", "1998-W09", ("1998-03-02", "1998-03-09", "1998-02-23", "1998-03-02")),
    "concat_sep": (_plan(Query("part").derive(label=joined(col("p_name"), col("p_brand"), col("p_size"), None, sep=" / ")).project("p_partkey", "label")), "SELECT p_partkey, p_name || ' / ' || p_brand || ' / ' || p_size || ' / ' AS label FROM part"),
    "concat_skip_nulls": (_plan(_NOTED.derive(label=joined(col("note"), col("o_orderstatus"), "  ", sep=", ", skip_blanks=True)).project("o_orderkey", "label")),
        "SELECT o_orderkey, concat_ws(', ', CASE WHEN o_totalprice < 100000 THEN o_orderpriority END, o_orderstatus) AS label FROM orders"),
    "trim_upper_lower": (_plan(Query("part").derive(padded=joined("  ", col("p_name"), "   x \t"), t=col("padded").text("trim"), u=col("p_name").text("upper"), l=col("p_brand").text("lower")).project("p_partkey", "t", "u", "l")),
        "SELECT p_partkey, p_name || ' x' AS t, upper(p_name) AS u, lower(p_brand) AS l FROM part"),
    "split_part": (_plan(Query("orders").derive(**{f"p{i}": col("o_orderpriority").split("-", i) for i in (1, 2, 3)}).project("o_orderkey", "p1", "p2", "p3")),
        "SELECT o_orderkey, string_split(o_orderpriority, '-')[1] AS p1, string_split(o_orderpriority, '-')[2] AS p2, string_split(o_orderpriority, '-')[3] AS p3 FROM orders"),
    "to_text_dates": (_plan(Query("orders").project("o_orderkey", **{n: _text("o_orderdate", x) for n, x in zip("abcdef", ("yyyy-mm-dd", "dd/mm/yyyy", "mm/dd/yyyy", "yyyy-mm", "mmm yyyy", "yyyy"), strict=True)})),
        "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS a, strftime(o_orderdate, '%d/%m/%Y') AS b, strftime(o_orderdate, '%m/%d/%Y') AS c, strftime(o_orderdate, '%Y-%m') AS d, strftime(o_orderdate, '%b %Y') AS e, strftime(o_orderdate, '%Y') AS f FROM orders"),
    "to_text_numbers": (_plan(Query("orders").project("o_orderkey", a=_text("o_orderkey", "0"), b=_text("o_totalprice", "0.00"), c=_text("o_orderkey", "#,##0"), d=_text("o_totalprice", "#,##0.00"), e=_text("o_orderkey", "0%"), f=_text("o_orderkey", "0.0%"))),
        "SELECT o_orderkey, o_orderkey::VARCHAR AS a, printf('%.2f', round(o_totalprice, 2)) AS b, format('{:,}', o_orderkey) AS c, format('{:,.2f}', round(o_totalprice, 2)) AS d, (o_orderkey * 100)::VARCHAR || '%' AS e, (o_orderkey * 100)::VARCHAR || '.0%' AS f FROM orders"),
    "sort_declared_order": (_plan(Query("orders").derive(size=_SIZE).sort("-size", "o_orderkey").limit(20).project("o_orderkey", "size")),
        f"SELECT o_orderkey, size FROM (SELECT o_orderkey, {_BUCKET} AS size FROM orders) ORDER BY CASE size WHEN 'huge' THEN 0 WHEN 'large' THEN 1 WHEN 'Medium' THEN 2 ELSE 3 END, o_orderkey LIMIT 20"),
    "sort_text_collation": (_plan(Query("part").sort("p_name", "p_partkey").limit(100)), "SELECT * REPLACE (round(p_retailprice, 2) AS p_retailprice) FROM part ORDER BY lower(p_name), p_partkey LIMIT 100"),
    "edit_add": (_plan(Edit("supplier").add("rich", choose((col("s_acctbal") > 5000, "yes"), otherwise="no"), after="s_name")), "SELECT *, CASE WHEN s_acctbal > 5000 THEN 'yes' ELSE 'no' END AS rich FROM supplier"),
    "edit_set": (_plan(Edit("supplier").set("s_acctbal", value(0), col("s_acctbal") < 0)), "SELECT s_suppkey, s_name, s_nationkey, CASE WHEN s_acctbal < 0 THEN 0 ELSE s_acctbal END AS s_acctbal FROM supplier"),
    "edit_drop": (_plan(Edit("supplier").drop("s_acctbal")), "SELECT s_suppkey, s_name, s_nationkey FROM supplier"),
    "edit_rename": (_plan(Edit("supplier").rename("S_NAME", "title")), "SELECT s_suppkey, s_name AS title, s_nationkey, s_acctbal FROM supplier"),
    "edit_move": (_plan(Edit("supplier").move("s_acctbal")), "SELECT s_acctbal, s_suppkey, s_name, s_nationkey FROM supplier"),
    "edit_drop_rows": (_plan(Edit("supplier").drop_rows(col("s_acctbal") < 1000)), "SELECT * FROM supplier WHERE NOT coalesce(s_acctbal < 1000, false)"),
    "profile_columns": (_profile("customer"), _profile_sql("customer")),
    "profile_lines": (_profile("lineitem"), _profile_sql("lineitem")),
    "infer_joins": (_joins, _joins_sql()),
    "load_text_numbers_dates": (_reload, "SELECT o_orderkey::DOUBLE AS o_orderkey, round(CASE WHEN o_orderkey % 3 = 0 THEN -round(o_totalprice, 2) ELSE round(o_totalprice, 2) END, 2) AS price, o_orderdate::DATE AS day FROM orders"),
    "load_dates_all": (_spelled, """
WITH d AS (
  SELECT o_orderkey::DOUBLE AS o_orderkey, o_orderkey % 13 AS k, CASE WHEN o_orderkey % 13 < 11 AND (o_orderkey % 13 NOT IN (7, 8) OR day(o_orderdate) > 12) THEN o_orderdate END AS t FROM orders)
SELECT o_orderkey, t::DATE AS day, CASE WHEN k = 9 THEN t + INTERVAL 450 MINUTE ELSE t END AS at, CASE WHEN t IS NULL AND k <> 12 THEN '#VALUE!' END AS error FROM d"""),
    "load_serials": (_serials, "SELECT o_orderkey::DOUBLE AS o_orderkey, o_orderdate::DATE AS day, o_orderdate + to_hours((o_orderkey % 4 * 6)::INT) AS at, o_orderdate + to_hours((o_orderkey % 4 * 6)::INT) AS at_1904 FROM orders"),
    "load_errors": (_errors_loaded, """
SELECT o_orderkey::DOUBLE AS o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'n/a' ELSE o_orderpriority END AS note, CASE WHEN o_orderkey % 5 > 2 THEN o_orderkey::DOUBLE END AS amount, CASE o_orderkey % 4 WHEN 0 THEN true WHEN 1 THEN false END AS flag,
  CASE WHEN o_orderkey % 7 = 0 THEN '#N/A' END AS note_error, CASE o_orderkey % 5 WHEN 0 THEN '#DIV/0!' WHEN 1 THEN '#VALUE!' END AS amount_error, CASE WHEN o_orderkey % 4 = 2 THEN '#VALUE!' END AS flag_error FROM orders"""),
    "load_notes": (_notes_loaded, """
SELECT 'note' AS "column", 0::BIGINT AS text_numbers, 0::BIGINT AS unreadable FROM (SELECT count(*) FROM orders)
UNION ALL SELECT 'amount', count(*) FILTER (WHERE o_orderkey % 5 > 2), count(*) FILTER (WHERE o_orderkey % 5 = 1) FROM orders UNION ALL SELECT 'flag', 0, count(*) FILTER (WHERE o_orderkey % 4 = 2) FROM orders"""),
    "agg_skip_errors": (_skip_errors, "SELECT l_returnflag, round(sum(l_tax / l_discount) FILTER (WHERE l_discount <> 0), 2) AS total, round(max(l_tax / l_discount) FILTER (WHERE l_discount <> 0), 2) AS top, count(*) AS n FROM lineitem GROUP BY 1"),
    "preview_issues": (_issues, """
WITH l AS (SELECT l_discount = 0 AS bad, l_discount <> 0 AND l_tax / nullif(l_discount, 0) > 1 AS kept, l_linestatus FROM lineitem),
n AS (SELECT count(*) FILTER (WHERE bad) AS bad, count(*) FILTER (WHERE kept) AS kept, count(*) AS lines, count(DISTINCT l_linestatus) AS groups, count(DISTINCT CASE WHEN bad THEN l_linestatus END) AS bad_groups FROM l)
SELECT * FROM (
  SELECT 'sum' AS plan, groups AS rows, 'LOAD_NOTE' AS code, 7::BIGINT AS n, false AS blocking FROM n UNION ALL SELECT 'sum', groups, 'ERROR_CELLS', bad, true FROM n UNION ALL SELECT 'sum', groups, 'ERRORS_IN_OUTPUT', bad_groups, false FROM n
  UNION ALL SELECT 'filter', kept, 'LOAD_NOTE', 7, false FROM n UNION ALL SELECT 'filter', kept, 'ERROR_CELLS', bad, true FROM n UNION ALL SELECT 'cells', lines, 'LOAD_NOTE', 7, false FROM n UNION ALL SELECT 'cells', lines, 'ERRORS_IN_OUTPUT', bad, false FROM n
  UNION ALL SELECT 'look-up', (SELECT count(*) FROM orders), 'LOAD_NOTE', 7, false
  UNION ALL SELECT 'look-up', (SELECT count(*) FROM orders), 'LOOKUP_KEY_NOT_UNIQUE', (SELECT count(*) - count(DISTINCT l_orderkey) FROM lineitem), true) WHERE n > 0"""),
    "template_fill": (_template, """SELECT c_custkey AS "No", c_name AS "Name", c_mktsegment AS "Segment", round(c_acctbal, 2) AS "Balance" FROM customer WHERE c_acctbal > 0"""),
    "classify_cells": (_classes, """SELECT CASE o_orderkey % 9 WHEN 0 THEN 'currency' WHEN 1 THEN 'number' WHEN 2 THEN 'percent' WHEN 3 THEN 'date' WHEN 4 THEN 'boolean' WHEN 5 THEN 'null' WHEN 6 THEN 'error' ELSE 'string' END AS class, count(*) AS cells FROM orders GROUP BY 1"""),
    "infer_kinds": (_kinds, _kinds_sql()),
    "profile_exemplars": (_exemplars, _exemplars_sql()),
    "sheet_regions": (_sheets, """
WITH s AS (SELECT o_custkey::VARCHAR AS sheet, count(*) AS n FROM orders GROUP BY 1)
SELECT sheet, 1::BIGINT AS region, 3::BIGINT AS header_row, 1::BIGINT AS header_rows, 4::BIGINT AS first_row, 3 + n AS last_row, 1::BIGINT AS first_col, 3::BIGINT AS last_col, n AS rows, 1::BIGINT AS skipped FROM s
UNION ALL SELECT sheet, 2, 3, 1, 4, 5, 5, 6, 2, 0 FROM s UNION ALL SELECT sheet, 3, n + 9, 2, n + 10, n + 11, 1, 4, 2, 0 FROM s"""),
    "sheet_headers": (_headers, """
WITH s AS (SELECT DISTINCT o_custkey::VARCHAR AS sheet FROM orders)
SELECT sheet, region::BIGINT AS region, col::BIGINT AS col, name FROM s, (VALUES (1, 1, 'Order'), (1, 2, 'Day'), (1, 3, 'Price'), (2, 5, 'Key'), (2, 6, 'Value'), (3, 1, 'Day'), (3, 2, 'Half Orders'), (3, 3, 'Half orders (2)'), (3, 4, 'Half Column D')) h(region, col, name)"""),
    "date_systems": (_date_systems, "SELECT o_orderpriority AS book, CASE WHEN o_orderpriority < '3' THEN '1900' ELSE '1904' END AS system, count(*) AS telling FROM orders GROUP BY 1"),
    "carry_table_ids": (_carried, "SELECT c_name AS sheet, CASE WHEN c_custkey % 3 = 2 THEN 'r:' || c_name || ':R1C1' ELSE 't' || c_custkey END AS id, CASE WHEN c_custkey % 3 = 1 THEN 'Area>Region' END AS renamed FROM customer"),
    "content_hash_guard": (_hash, "SELECT count(*) AS rows, change, change <> 'order of rows' AS told FROM orders, (VALUES ('order of rows'), ('one cell'), ('null in another column'), ('name'), ('type'), ('one row less')) v(change) GROUP BY change"),
}
QUERIES = {name: q for name, (q, _) in PLANS.items()}
ORACLES = {name: sql for name, (_, sql) in PLANS.items() if sql}
__all__ = ["ORACLES", "QUERIES", "environment"]
