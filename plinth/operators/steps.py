"""The ten steps of query plans."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import replace

from pyspark.sql import Column, Observation
from pyspark.sql import functions as F

from ..functions import cells, text
from ..model import ERROR, MAX_PIVOT, RID, Entity, Environment, Frame, Kind, PlanError
from ..plans.expressions import Compiler, Val
from .aggregate import aggregate


class Context:
    """What steps need besides the frame."""

    def __init__(self, env: Environment, params: dict[str, tuple[str, object]], skip_errors: bool = False, ordered: bool = True):
        self.env, self.params, self.skip_errors, self.ordered = env, params, skip_errors, ordered


def new_name(name: str, taken) -> str:
    if not name.strip() or name.startswith("__"):
        raise PlanError("E_PARSE_INVALID_VALUE", f"{name!r} can't name a column")
    if name.lower() in {t.lower() for t in taken}:
        raise PlanError("E_DERIVE_COLUMN_COLLISION", f"a column named {name!r} exists")
    return name


def put(frame: Frame, name: str, v: Val) -> Frame:
    """``frame`` with a column, and its errors beside it."""
    df = frame.df.withColumn(name, v.value.cast("string") if v.kind.base == "null" else v.value)
    kind = replace(v.kind, base="text") if v.kind.base == "null" else v.kind
    errors = set(frame.errors) - {name}
    if v.error is not None:
        df, errors = df.withColumn(ERROR + name, v.error), errors | {name}
    return replace(frame, df=df, kinds={**frame.kinds, name: kind}, errors=frozenset(errors))


def met(frame: Frame, code: str, count: Column) -> Frame:
    """``frame`` that counts something while it runs; no job of its own."""
    seen = Observation()
    return replace(frame, df=frame.df.observe(seen, count.alias("n")), seen=(*frame.seen, (code, seen)))


def filter_rows(frame: Frame, step: dict, ctx: Context) -> Frame:
    keep = Compiler(frame, ctx.params).predicate(step["predicate"])
    if frame.errors:  # an answer is unknown where an error was met
        unknown = Compiler(frame, ctx.params).predicate(step["predicate"], positive=False).isNull()
        frame = met(frame, "ERROR_CELLS", F.count_if(unknown))
    return replace(frame, df=frame.df.filter(keep), measures=frozenset())


def derive(frame: Frame, step: dict, ctx: Context) -> Frame:
    out = put(frame, new_name(step["as"], frame.kinds), Compiler(frame, ctx.params).expr(step["expr"]))
    return out  # measures stay known: several derives may follow an aggregate


def project(frame: Frame, step: dict, ctx: Context) -> Frame:
    names = [c["as"] for c in step["columns"]]
    if len({n.lower() for n in names}) < len(names):
        raise PlanError("E_DUPLICATE_OUTPUT_COLUMN", f"a name is used twice: {', '.join(names)}")
    compiler, out, kinds, errors, origin = Compiler(frame, ctx.params), [], {}, set(), {}
    compiler.depth = 1 if ctx.env is not None and step.get("_text") else 0
    for c in step["columns"]:
        v = compiler.expr(c["expr"])
        out.append((v.value.cast("string") if v.kind.base == "null" else v.value).alias(c["as"]))
        kinds[c["as"]] = replace(v.kind, base="text") if v.kind.base == "null" else v.kind
        if v.error is not None:
            out.append(v.error.alias(ERROR + c["as"]))
            errors.add(c["as"])
        if c["expr"]["type"] == "col" and frame.name(c["expr"]["col"]) in frame.origin:
            origin[c["as"]] = frame.origin[frame.name(c["expr"]["col"])]
    gone = frozenset({*frame.gone, *[c.lower() for c in frame.kinds]} - {n.lower() for n in names})
    rid = [RID] if RID in frame.df.columns else []
    return Frame(frame.df.select(*out, *rid), kinds, frozenset(errors), origin, gone, frozenset(), frame.sorted, frame.seen)


def aggregate_rows(frame: Frame, step: dict, ctx: Context) -> Frame:
    out, found = aggregate(frame, step, ctx.params, ctx.skip_errors)
    return _counted(out, found, ctx)


def _counted(out: Frame, found: Column | None, ctx: Context) -> Frame:
    """An aggregate that tells how many error cells its measures met."""
    if found is None:
        return out
    return met(out, "ERROR_CELLS_EXCLUDED" if ctx.skip_errors else "ERROR_CELLS", found)


def sort(frame: Frame, step: dict, ctx: Context) -> Frame:
    keys: list[Column] = []
    for k in step["by"]:
        own = frame.name(k["col"])
        kind = frame.kinds[own]
        if kind.order == "missing":
            raise PlanError("E_SORT_CATEGORICAL_UNORDERED", f"{own!r} has an order that nobody has declared")
        order = list(kind.order) if isinstance(kind.order, tuple) else None
        keys += cells.order_by(F.col(f"`{own}`"), k.get("dir", "asc"), kind.text, order, frame.error(own))
    rid = [F.col(RID)] if RID in frame.df.columns else []
    return replace(frame, df=frame.df.orderBy(*keys, *rid), sorted=True, measures=frozenset())


def limit(frame: Frame, step: dict, ctx: Context) -> Frame:
    if step["n"] < 1:
        raise PlanError("E_LIMIT_NOT_POSITIVE", "a limit is 1 or more")
    df = frame.df if frame.sorted or RID not in frame.df.columns else frame.df.orderBy(RID)
    return replace(frame, df=df.limit(step["n"]), measures=frozenset())


def _link(frame: Frame, step: dict, ctx: Context) -> tuple[str, Entity, str]:
    """The left key, the other entity and its key, if an approved link joins them."""
    other = ctx.env.entity(step["with"], "E_JOIN_ENTITY_UNKNOWN")
    left, columns = frame.name(step["on"]["left"]), {c.lower(): c for c in other.columns()}
    right = columns.get(step["on"]["right"].lower())
    if right is None:
        raise PlanError("E_UNKNOWN_COLUMN", f"{other.name!r} has no column {step['on']['right']!r}", names=list(columns.values()), wanted=step["on"]["right"])
    ends = {(*(x.lower() for x in frame.origin.get(left, ("", ""))), other.name.lower(), right.lower())}
    for link in ctx.env.links:
        way = (link.left.lower(), link.left_column.lower(), link.right.lower(), link.right_column.lower())
        if link.approved and ({way} & ends or {(*way[2:], *way[:2])} & ends):
            break
    else:
        raise PlanError("E_UNAPPROVED_JOIN", f"no approved link leads from {left!r} to {other.name}.{right}")
    a, b = frame.kinds[left], other.columns()[right]
    if a.base != b.base and {a.base, b.base} != {"date", "datetime"}:
        raise PlanError("E_JOIN_KEY_TYPE_MISMATCH", f"{a.base} joined with {b.base}")
    return left, other, right


def _free_name(name: str, entity: str, taken: set[str]) -> str:
    found, n = name, 1
    while found.lower() in taken:
        found = f"{name} ({entity})" + (f" {n}" if n > 1 else "")
        n += 1
    taken.add(found.lower())
    return found


def _key(c: str, kind: Kind) -> Column:
    return cells.key(F.col(f"`{c}`"), kind.text and not kind.canonical)


def _beside(frame: Frame, other: Frame, entity: str, take: list[str]) -> tuple[list[Column], dict[str, Kind], dict[str, tuple[str, str]], set[str]]:
    """Columns of the other side under free names."""
    taken, cols, kinds, origin, errors = {c.lower() for c in frame.kinds}, [], {}, {}, set()
    for c in take:
        name = _free_name(c, entity, taken)
        cols.append(F.col(f"`{c}`").alias(name))
        kinds[name], origin[name] = replace(other.kinds[c], nullable=True), (entity, c)
        if c in other.errors:
            cols.append(other.error(c).alias(ERROR + name))
            errors.add(name)
    return cols, kinds, origin, errors


def _keyed(frame: Frame, left: str) -> tuple[Frame, Column]:
    """The left side with its key, and how it is met: rows of a blank key, which meet nothing, are dealt by all of
    their values, so that an outer join doesn't send them to one task."""
    spread = F.when(F.col("__kl").isNull(), F.xxhash64(*[F.col(f"`{c}`") for c in frame.kinds])).otherwise(F.xxhash64("__kl"))
    df = frame.df.withColumn("__kl", _key(left, frame.kinds[left])).withColumn("__hl", spread)
    return replace(frame, df=df), (F.col("__kl") == F.col("__kr")) & (F.col("__hl") == F.col("__hr"))


def join(frame: Frame, step: dict, ctx: Context) -> Frame:
    left, other, right = _link(frame, step, ctx)
    side = Frame.of(other)
    cols, kinds, origin, errors = _beside(frame, side, other.name, list(side.kinds))
    b = side.df.select(_key(right, side.kinds[right]).alias("__kr"), *cols).withColumn("__hr", F.xxhash64("__kr"))
    if step.get("kind") == "left":
        a, same = _keyed(frame, left)
        df = a.df.join(b, same, "left")
    else:
        df = frame.df.withColumn("__kl", _key(left, frame.kinds[left])).join(b, F.col("__kl") == F.col("__kr"))
    return Frame(df.drop("__kl", "__kr", "__hl", "__hr"), {**frame.kinds, **kinds}, frame.errors | errors, {**frame.origin, **origin}, frame.gone, frozenset(), False, frame.seen)


def lookup(frame: Frame, step: dict, ctx: Context) -> Frame:
    left, other, right = _link(frame, step, ctx)
    if right not in other.unique:
        raise PlanError("E_LOOKUP_KEY_NOT_UNIQUE", f"{other.name}.{right} repeats")
    side = Frame.of(other).in_order()
    take = [c for c in side.kinds if c != right]
    if step.get("take") is not None:
        take = [side.name(c) for c in step["take"]]
    cols, kinds, origin, errors = _beside(frame, side, other.name, take)
    # The first row of a key counts, should it repeat after all, and the other rows are counted: they stop a commit.
    keyed = side.df.withColumn("__kr", _key(right, side.kinds[right])).where("__kr is not null")
    picked = keyed.groupBy("__kr").agg(F.min_by(F.struct(*cols, F.lit(1).alias("__one")), F.col(RID)).alias("__take"), F.count(F.lit(1)).alias("__rows"))
    repeats = Observation()
    picked = picked.observe(repeats, F.sum(F.col("__rows") - 1).alias("n"))
    b = picked.select("__kr", F.xxhash64("__kr").alias("__hr"), *[F.col(f"__take.`{c}`") for c in [*kinds, *[ERROR + e for e in errors]]])
    a, same = _keyed(frame, left)
    df = a.df.join(b, same, "left").drop("__kl", "__kr", "__hl", "__hr")
    return replace(frame, df=df, kinds={**frame.kinds, **kinds}, errors=frame.errors | errors, origin={**frame.origin, **origin}, measures=frozenset(), sorted=False, seen=(*frame.seen, ("LOOKUP_KEY_NOT_UNIQUE", repeats)))


def pivot(frame: Frame, step: dict, ctx: Context) -> Frame:
    rows, cols, values = [frame.name(r) for r in step["rows"]], frame.name(step["cols"]), frame.name(step["values"])
    kind = frame.kinds[cols]
    if frame.kinds[values].base != "number":
        raise PlanError("E_PIVOT_VALUE_NOT_NUMERIC", f"{values!r} holds no numbers")
    if not kind.text and not (kind.base == "number" and kind.bound is not None):
        raise PlanError("E_PIVOT_NON_CATEGORICAL_COLS", f"{cols!r} is no category")
    if (kind.bound or 0) > MAX_PIVOT:
        raise PlanError("E_PIVOT_HIGH_CARDINALITY", f"{cols!r} may have {kind.bound} values")
    head = _key(cols, kind)
    if kind.text:
        seen = frame.df.select(head.alias("k"), F.col(f"`{cols}`").alias("c"), *([RID] if RID in frame.df.columns else [])).groupBy("k")
        heads = seen.agg((F.min_by("c", RID) if RID in frame.df.columns else F.min("c")).alias("c"))
    else:
        heads = frame.df.select(F.col(f"`{cols}`").alias("k"), F.col(f"`{cols}`").alias("c")).distinct()
    shown = text.display(F.col("c"), kind.base).alias("shown")
    order = cells.order_by(F.col("c"), "asc", kind.text, list(kind.order) if isinstance(kind.order, tuple) else None)
    found = heads.orderBy(*order).select("k", shown).limit(MAX_PIVOT + 1).collect()  # 51 rows at most
    if len(found) > MAX_PIVOT:
        raise PlanError("E_PIVOT_HIGH_CARDINALITY", f"{cols!r} has more than {MAX_PIVOT} values")
    taken, names = {r.lower() for r in rows}, []
    for r in found:
        base = name = "(blank)" if r["shown"] is None else r["shown"]
        n = 2
        while name.lower() in taken:
            name, n = f"{base} {n}", n + 1
        taken.add(name.lower())
        names.append(name)
    grouped = [
        {"fn": "sum", "of": values, "as": f"__p{i}"} for i in range(len(found))
    ]
    marked = frame
    for i, r in enumerate(found):
        same = head.isNull() if r["k"] is None else head == F.lit(r["k"])
        marked = put(marked, f"__v{i}", Val(F.when(same, F.col(f"`{values}`")), frame.kinds[values]))
    for i, g in enumerate(grouped):
        g["of"] = f"__v{i}"
    out, _ = aggregate(marked, {"groupBy": rows, "measures": grouped}, ctx.params, ctx.skip_errors)
    df = out.df.withColumnsRenamed({f"__p{i}": name for i, name in enumerate(names)})
    value_kind = replace(frame.kinds[values], nullable=True)
    return Frame(df, {**{r: frame.kinds[r] for r in rows}, **dict.fromkeys(names, value_kind)}, frozenset(), {}, out.gone, frozenset(), seen=out.seen)


#: Literals of periods by grain (fixed formats).
PERIODS = {"year": r"(\d{4})", "quarter": r"(\d{4})-Q([1-4])", "month": r"(\d{4})-(0[1-9]|1[0-2])", "week": r"(\d{4})-W(0[1-9]|[1-4]\d|5[0-3])", "day": r"(\d{4})-(\d\d)-(\d\d)"}


def period_range(grain: str, literal: str, week_start: str | None = "monday") -> tuple[dt.date, dt.date]:
    """First day and the day after the last one."""
    m = re.fullmatch(PERIODS[grain], literal)
    try:
        if not m:
            raise ValueError
        n = [int(x) for x in m.groups()]
        if grain == "year":
            return dt.date(n[0], 1, 1), dt.date(n[0] + 1, 1, 1)
        if grain in ("quarter", "month"):
            months = 3 if grain == "quarter" else 1
            at = n[0] * 12 + (n[1] - 1) * months
            return dt.date(at // 12, at % 12 + 1, 1), dt.date((at + months) // 12, (at + months) % 12 + 1, 1)
        if grain == "week":
            monday = dt.date.fromisocalendar(n[0], 1, 1) + dt.timedelta(weeks=n[1] - 1)
            start = monday - dt.timedelta(days=1 if week_start == "sunday" else 0)
            return start, start + dt.timedelta(days=7)
        day = dt.date(*n)
        return day, day + dt.timedelta(days=1)
    except ValueError as e:
        raise PlanError("E_PERIOD_COMPARE_INVALID_PERIOD", f"{literal!r} is no {grain}") from e


def period_compare(frame: Frame, step: dict, ctx: Context) -> Frame:
    metric = next((m for m in ctx.env.metrics if m.name.lower() == step["metric"].lower()), None)
    if metric is None:
        raise PlanError("E_UNKNOWN_METRIC", f"there is no metric {step['metric']!r}", names=[m.name for m in ctx.env.metrics], wanted=step["metric"])
    dim = next((t for t in ctx.env.time_dimensions if t.name.lower() == step["timeDim"].lower()), None)
    if dim is None or dim.entity.lower() != metric.entity.lower():
        raise PlanError("E_PERIOD_COMPARE_NO_TIME_DIM", f"{step['timeDim']!r} is no time dimension of {metric.entity}")
    grain = step["grain"]
    if grain not in dim.grains or (grain == "week" and dim.week_start is None):
        raise PlanError("E_PERIOD_COMPARE_UNSUPPORTED_GRAIN", f"{dim.name} has no grain {grain!r}")
    ranges = {side: period_range(grain, step[side], dim.week_start) for side in ("current", "prior")}
    when = F.col(f"`{frame.name(dim.column)}`")
    inside = {side: (when >= F.lit(a)) & (when < F.lit(b)) for side, (a, b) in ranges.items()}
    slug = re.sub(r"[^a-z0-9]+", "_", metric.name.lower()).strip("_")
    names = {"current": f"current_{slug}", "prior": f"prior_{slug}"}
    groups = step.get("groupBy") or []
    rows = replace(frame, df=frame.df.filter(inside["current"] | inside["prior"]))
    if metric.where:
        rows = filter_rows(rows, {"predicate": metric.where}, ctx)
    rows = rows.in_order() if ctx.ordered else rows  # above the filters, which so reach the scan
    measures = []
    for side in names:  # one pass: each side's measure sees its own rows only
        rows = put(rows, f"__in_{side}", Val(inside[side], Kind("bool")))
        own = {"op": "eq", "left": {"type": "col", "col": f"__in_{side}"}, "right": {"type": "lit", "value": True}}
        measures += [{"fn": metric.fn, "of": metric.of, "as": names[side], "where": own}, {"fn": "countIf", "of": "*", "as": f"__n_{side}", "where": own}]
        if RID in rows.df.columns:
            measures.append({"fn": "min", "of": f"__r_{side}", "as": f"__first_{side}"})
            rows = put(rows, f"__r_{side}", Val(F.when(F.col(f"__in_{side}"), F.col(RID)), Kind("number")))
    out, found = aggregate(rows, {"groupBy": groups, "measures": measures}, ctx.params, ctx.skip_errors)
    out = _counted(out, found, ctx)
    df = out.df
    if groups:  # a side without rows is null, even if the metric counts
        df = df.withColumns({n: F.when(F.col(f"__n_{side}") > 0, F.col(n)) for side, n in names.items()})
    now, before = (F.col(n) for n in names.values())
    delta = now - before
    df = df.withColumns({"delta": delta, "delta_pct": F.when(before != 0, F.try_divide(delta.cast("double"), before.cast("double")))})
    if RID in df.columns:  # groups of the current period come first
        first, then = (F.when(F.col(f"__first_{side}").isNotNull(), F.struct(F.lit(i).alias("side"), F.col(f"__first_{side}").alias("at"))) for i, side in enumerate(names))
        df = df.withColumn(RID, F.coalesce(first, then))
    kind = replace(out.kinds[names["current"]], nullable=True)
    kinds = {**{g: out.kinds[g] for g in out.kinds if g.lower() in [x.lower() for x in groups]}, names["current"]: kind, names["prior"]: kind, "delta": kind, "delta_pct": Kind("number", "percent")}
    errors = frozenset(c for c in out.errors if c in kinds)
    keep = [*kinds, *[ERROR + e for e in errors], *([RID] if RID in df.columns else [])]
    return Frame(df.select(*[f"`{c}`" for c in keep]), kinds, errors, out.origin, out.gone, frozenset(list(names.values())), seen=out.seen)


STEPS = {
    "filter": filter_rows, "derive": derive, "project": project, "aggregate": aggregate_rows, "sort": sort, "limit": limit,
    "join": join, "lookup": lookup, "pivot": pivot, "periodCompare": period_compare,
}
