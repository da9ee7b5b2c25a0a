"""Grouping with measures.

Text keys group ignoring case and show the spelling met first.  Rows are first
grouped by the raw keys, and by the values of distinct counts (a hash aggregation
with map-side combining), and only those groups are folded, so that one scan gives
counts and spellings.  Measures that may meet errors need rows in order and are
folded at once.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import cells
from ..model import ERROR, RID, Frame, Kind, PlanError
from ..plans.expressions import Compiler

FUNCTIONS = ("count", "countDistinct", "countIf", "sum", "avg", "min", "max")
COUNT = Kind("number", nullable=False)


def _kind(frame: Frame, m: dict) -> Kind:
    fn, of = m["fn"], m["of"]
    if fn not in FUNCTIONS:
        raise PlanError("E_PARSE_INVALID_VALUE", f"unknown aggregate function {fn!r}")
    if fn == "countIf" and not m.get("where"):
        raise PlanError("E_COUNTIF_NO_PREDICATE", "countIf needs a where")
    if of == "*":
        if fn not in ("count", "countIf"):
            raise PlanError("E_TYPE_MISMATCH", f"{fn} needs a column")
        return COUNT
    kind = frame.kinds[frame.name(of)]
    if fn in ("count", "countDistinct", "countIf"):
        return COUNT
    if kind.base != "number" and not (fn in ("min", "max") and kind.base in ("date", "datetime")):
        raise PlanError("E_TYPE_MISMATCH", f"{fn} of {kind.base}")
    return replace(kind, bound=None, nullable=kind.nullable or bool(m.get("where")))


def aggregate(frame: Frame, step: dict, params: dict, skip_errors: bool = False) -> tuple[Frame, Column | None]:
    """The groups, and a column that sums up the error cells met (None where there can't be any)."""
    groups: list[str] = []
    for g in step["groupBy"]:
        own = frame.name(g, "E_AGGREGATE_GROUPBY_UNKNOWN") if g.lower() not in frame.gone else frame.name(g)
        if own not in groups:
            groups.append(own)
    measures = step["measures"]
    names = [*groups, *[m["as"] for m in measures]]
    if len({n.lower() for n in names}) < len(names):
        raise PlanError("E_DUPLICATE_OUTPUT_COLUMN", f"a name is used twice: {', '.join(names)}")
    compiler = Compiler(frame, params)
    kinds = {m["as"]: _kind(frame, m) for m in measures}
    folded = [g for g in groups if frame.kinds[g].text and not frame.kinds[g].canonical]
    shadows = [g for g in groups if g in frame.errors]
    failing = [m for m in measures if m["of"] != "*" and frame.name(m["of"]) in frame.errors]

    rid = F.col(RID) if RID in frame.df.columns else None
    raw_key = {g: F.col(f"`{g}`") for g in groups}
    shadow_key = {ERROR + g: frame.error(g) for g in shadows}
    fold_key = {f"__k{i}": cells.key(raw_key[g], True) for i, g in enumerate(groups) if g in folded}
    if folded and not failing:
        partial = [p for i, m in enumerate(measures) if m["fn"] != "countDistinct" for p in _partials(compiler, m, i)]
        values = {f"__d{i}": _distinct_key(compiler, m) for i, m in enumerate(measures) if m["fn"] == "countDistinct"}
        df = frame.df.groupBy(*[c.alias(n) for n, c in {**raw_key, **shadow_key, **values}.items()]).agg(F.min(rid).alias(RID), *partial)
        merged = [_merge(m, i).alias(m["as"]) for i, m in enumerate(measures)]
    else:
        df = frame.df
        merged = [x for m in measures for x in _direct(frame, compiler, m, skip_errors)]
        merged += [F.count(_subject(compiler, m)[1]).alias(f"__errors{i}") for i, m in enumerate(failing)]
    plain = [*[raw_key[g].alias(g) for g in groups if g not in folded], *[F.col(f"`{s}`") for s in shadow_key]]
    if folded:
        first = [F.min_by(raw_key[g], F.col(RID)).alias(g) for g in folded]
        df = df.withColumns(fold_key).groupBy(*plain, *fold_key).agg(*first, *merged, F.min(RID).alias(RID)).drop(*fold_key)
    else:
        out = [*merged, *([F.min(rid).alias(RID)] if rid is not None else [])]
        df = (df.groupBy(*plain).agg(*out) if out else df.select(*plain).distinct()) if plain else df.agg(*(out or [F.count("*").alias("__n")]))
    kinds = {**{g: frame.kinds[g] for g in groups}, **kinds}
    errors = {*shadows, *[m["as"] for m in measures if ERROR + m["as"] in df.columns]}
    hidden = [c for c in df.columns if c.startswith((ERROR, "__errors")) or c == RID]
    gone = frozenset({*frame.gone, *[c.lower() for c in frame.kinds]} - {n.lower() for n in names})
    df = df.select(*[f"`{n}`" for n in kinds], *[f"`{h}`" for h in hidden])
    met = sum((F.sum(f"__errors{i}") for i in range(len(failing))), F.lit(0)) if failing else None
    return Frame(df, kinds, frozenset(errors), {g: frame.origin[g] for g in groups if g in frame.origin}, gone, frozenset(m["as"] for m in measures), seen=frame.seen), met


def _distinct_key(compiler: Compiler, m: dict) -> Column:
    c, _, text = _subject(compiler, m)
    return cells.key(c, text)


def _subject(compiler: Compiler, m: dict) -> tuple[Column, Column | None, bool]:
    """The value to reduce (null where ``where`` doesn't hold), its error, and if it is text."""
    where = compiler.predicate(m["where"]) if m.get("where") else None
    if m["of"] == "*":
        one = F.lit(1)
        return (one if where is None else F.when(where, one)), None, False
    v = compiler.column(m["of"])
    pick = lambda c: c if where is None or c is None else F.when(where, c)
    return pick(v.value), pick(v.error), v.kind.text


def _partials(compiler: Compiler, m: dict, i: int) -> list[Column]:
    c, _, text = _subject(compiler, m)
    fn = m["fn"]
    if fn in ("count", "countIf"):
        return [F.count(F.when(~cells.blank(c, text), 1)).alias(f"__m{i}")]
    if fn == "avg":
        return [F.sum(c.cast("double")).alias(f"__m{i}"), F.count(c).alias(f"__n{i}")]
    return [{"sum": F.sum, "min": F.min, "max": F.max}[fn](c).alias(f"__m{i}")]


def _merge(m: dict, i: int) -> Column:
    if m["fn"] == "countDistinct":
        return F.count_distinct(F.col(f"__d{i}"))
    part = F.col(f"__m{i}")
    if m["fn"] in ("count", "countIf", "sum"):
        return F.sum(part)
    if m["fn"] == "avg":
        return F.try_divide(F.sum(part), F.sum(f"__n{i}"))
    return (F.min if m["fn"] == "min" else F.max)(part)


def _direct(frame: Frame, compiler: Compiler, m: dict, skip_errors: bool) -> list[Column]:
    c, error, text = _subject(compiler, m)
    fn = m["fn"]
    if fn in ("count", "countIf"):
        present = ~cells.blank(c, text) if error is None else ~cells.blank(c, text) | error.isNotNull()
        return [F.count(F.when(present, 1)).alias(m["as"])]
    if fn == "countDistinct":
        seen = cells.key(c, text)
        return [F.count_distinct(seen if error is None else F.coalesce(F.concat(F.lit("v"), seen.cast("string")), F.concat(F.lit("e"), error))).alias(m["as"])]
    value = {"sum": F.sum, "avg": lambda x: F.avg(x.cast("double")), "min": F.min, "max": F.max}[fn](c)
    if error is None or skip_errors:
        return [value.alias(m["as"])]
    first = F.min_by(error, F.when(error.isNotNull(), F.col(RID)))
    return [F.when(F.count(error) == 0, value).alias(m["as"]), first.alias(ERROR + m["as"])]
