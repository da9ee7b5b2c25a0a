"""Check and compile plans; preview and write their results.

Checking is compiling: names, types, units, links and places are looked at while
the lazy DataFrame is built from schemas alone, before any row is read.  Only a
pivot reads (its at most 51 headers).
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
from dataclasses import dataclass, field
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.canonical import canonical_json
from ..model import ERROR, RID, Diagnostic, Entity, Environment, Frame, PlanError
from ..operators.edits import EDITS, Impact
from ..operators.steps import STEPS, Context
from .shape import parse, pointer_to

#: What sheet names may not have, and cells (fixed values).
NAME_LENGTH, FORBIDDEN, RESERVED, CELL = 31, r"[\[\]:*?/\\]", "history", r"[A-Za-z]{1,3}[1-9]\d{0,6}"
ORDER_NEEDED = {"limit", "sort", "aggregate", "pivot", "periodCompare"}
#: Steps that keep rows and their order, so that the order can be told after them as well; periodCompare sees to itself.
ROW_BY_ROW = {"filter", "derive", "project", "periodCompare"}
#: Lists of steps whose elements are checked one by one when a step fails.
ELEMENTS = {"project": ("columns",), "aggregate": ("groupBy", "measures"), "sort": ("by",)}
BLOCKING = {"ERROR_CELLS", "LOOKUP_KEY_NOT_UNIQUE", "OVERWRITES_SOURCE"}


@dataclass
class Result:
    """A compiled plan: the result without hidden columns, and what was learned on the way."""

    frame: Frame
    plan: dict
    warnings: list[str] = field(default_factory=list)
    impact: Impact | None = None
    params: dict | None = None
    target: str | None = None  # the new sheet's name
    bindings: dict[str, dict] = field(default_factory=dict)  # table: its id and the ids of the columns that the plan can read
    notes: list[tuple[str, int]] = field(default_factory=list)  # what loading the tables met

    @property
    def df(self) -> DataFrame:
        return self.frame.visible()

    @property
    def plan_hash(self) -> str:
        return plan_hash(self.plan)


def plan_hash(plan: dict) -> str:
    """SHA-256 of the plan's canonical JSON without nulls: equal for plans that say the same, however they are written."""
    bare = lambda x: {k: bare(v) for k, v in x.items() if v is not None} if isinstance(x, dict) else [bare(v) for v in x] if isinstance(x, list) else x
    return "sha256:" + hashlib.sha256(canonical_json({"irVersion": "1.2", "plan": bare(plan)}).encode()).hexdigest()


@dataclass
class Report:
    """What checking found: errors and warnings, and the compiled plan if there are no errors."""

    errors: list[Diagnostic]
    warnings: list[str]
    result: Result | None


def check(plan: str | dict, env: Environment, params: dict | None = None) -> Report:
    """All that is wrong with a plan's shape, or with the first step that fails."""
    try:
        result = compile_plan(plan, env, params)
    except PlanError as e:
        return Report(e.diagnostics, [], None)
    return Report([], result.warnings, result)


def _step_error(e: PlanError, step: dict, at: str, alone) -> PlanError:
    """The error with pointers to the parts that are wrong; ``alone`` runs the step with one element of a list."""
    found = []
    for name in ELEMENTS.get(step["op"], ()):
        for i, element in enumerate(step[name]):
            rest = {n: [] for n in ELEMENTS[step["op"]]} | {name: [element]}
            try:
                alone({**step, **rest})
            except PlanError as x:
                found.append(_placed(x, element, f"{at}/{name}/{i}"))
    clauses = step["predicate"].get("clauses", []) if step["op"] == "filter" else []
    for i, clause in enumerate(clauses):
        try:
            alone({**step, "predicate": clause})
        except PlanError as x:
            found.append(_placed(x, clause, f"{at}/predicate/clauses/{i}"))
    return PlanError.of([*found] or [_placed(e, step, at)])


def _placed(e: PlanError, part, at: str) -> Diagnostic:
    d = e.diagnostics[0]
    where = pointer_to(part, e.node, at) if e.node is not None else None
    if d.wanted is not None:
        where = pointer_to(e.node if where is not None else part, d.wanted, where or at) or where
    d.at = d.at or where or at
    return d


def _parameters(plan: dict, values: dict | None) -> dict[str, tuple[str, object]]:
    given = {k.lower(): v for k, v in (values or {}).items()}
    return {p["name"]: (p["valueType"], given.get(p["name"].lower())) for p in plan.get("params") or []}


def compile_plan(plan: str | dict, env: Environment, params: dict | None = None, exclude_error_cells: bool = False) -> Result:
    """The lazy result of a plan; raises PlanError with what is wrong."""
    plan = parse(plan)
    result = _compile_edit(plan, env, params) if plan["kind"] == "edit" else _compile_query(plan, env, params, exclude_error_cells)
    sources = [env.entity(n) for n in sorted(_sources(plan))]
    result.bindings = {e.name: _binding(e, plan) for e in sources}
    result.notes = [n for e in sources for n in e.notes if n[1]]
    return result


def _compile_query(plan: dict, env: Environment, params: dict | None, exclude_error_cells: bool) -> Result:
    try:
        entity = env.entity(plan["source"])
    except PlanError as e:
        raise PlanError.of([_placed(e, plan, "")]) from None
    steps, ops = plan["steps"], [s["op"] for s in plan["steps"]]
    ordered = bool(ORDER_NEEDED & {*ops}) or any(ERROR in c for c in entity.df.columns)
    frame = Frame.of(entity)
    ctx = Context(env, _parameters(plan, params), exclude_error_cells, ordered)
    warnings = []
    if "pivot" in ops[:-1]:
        raise PlanError("E_PIVOT_NOT_TERMINAL", "nothing follows a pivot", f"/steps/{ops.index('pivot') + 1}")
    if "periodCompare" in ops and set(ops[: ops.index("periodCompare")]) - {"filter"}:
        raise PlanError("E_PERIOD_COMPARE_PLACEMENT", "only filters come before a period comparison", f"/steps/{ops.index('periodCompare')}")
    for i, step in enumerate(steps):
        if step["op"] == "limit" and "sort" not in ops[:i]:
            warnings.append("W_LIMIT_WITHOUT_SORT")
        warnings += _unlikely(step, frame) + _text_numbers(step, frame, env)
        text_ok = step["op"] == "project" and plan["sink"]["mode"] == "template" and i == len(steps) - 1
        told = {"_text": True} if text_ok else {}
        if ordered and step["op"] not in ROW_BY_ROW:
            frame = frame.in_order()
        run = lambda s, now=frame, more=told: STEPS[s["op"]](now, s | more, ctx)
        try:
            frame = run(step)
        except PlanError as e:
            raise _step_error(e, step, f"/steps/{i}", run) from None
    if not steps:
        if plan["sink"]["mode"] != "newSheet":
            raise PlanError("E_EMPTY_PIPELINE_WRITE", "a plan without steps writes to a new table only", "/sink")
        warnings.append("W_TRIVIAL_PLAN")
    if plan["sink"]["mode"] == "template":
        warnings += _fit_template(frame, plan, env)
    if frame.errors:
        warnings.append("W_MAY_CONTAIN_ERRORS")
    new = plan["sink"]["mode"] == "newSheet"
    return Result(frame, plan, list(dict.fromkeys(warnings)), params=params, target=sheet_name(plan["sink"].get("name"), env.sheets) if new else None)


def _texts(x) -> set[str]:
    if isinstance(x, str):
        return {x.lower()}
    inner = x.values() if isinstance(x, dict) else x if isinstance(x, list) else ()
    return set().union(*map(_texts, inner))


def table_id(entity: Entity) -> str:
    return entity.id or f"t:{entity.name}"


def column_ids(names) -> list[str]:
    """Ids that columns keep while their names stay: a hash of the name, numbered where names repeat."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        own = "h:" + hashlib.sha256(n.strip().lower().encode()).hexdigest()[:14]
        seen[own] = seen.get(own, 0) + 1
        out.append(own if seen[own] == 1 else f"{own}~{seen[own]}")
    return out


def _binding(entity: Entity, plan: dict) -> dict:
    """The ids that the plan depends on: of the columns that it names, or of all where it gives out the table's own."""
    columns = dict(zip(entity.columns(), column_ids(entity.columns()), strict=True))
    shaped = any(s["op"] in ("project", "aggregate", "pivot", "periodCompare") for s in plan.get("steps", []))
    said = _texts(plan)
    read = {c: i for c, i in columns.items() if c.lower() in said} if shaped else columns
    return {"id": table_id(entity), "columns": read}


def refuse_changed(result: Result, env: Environment) -> None:
    """A plan runs only where the tables and columns that it was bound to still are."""
    for name, bound in result.bindings.items():
        now = next((e for e in env.entities.values() if table_id(e) == bound["id"]), None)
        if now is None:
            raise PlanError("PREVIEW_REFUSED", f"the table {name!r} is gone")
        if gone := set(bound["columns"].values()) - set(column_ids(now.columns())):
            raise PlanError("PREVIEW_REFUSED", f"{name!r} has lost {', '.join(c for c, i in bound['columns'].items() if i in gone)}")


def _unlikely(node, frame: Frame) -> list[str]:
    """Warns of literals that a column with known members is compared with but has not."""
    if isinstance(node, list):
        return [w for n in node for w in _unlikely(n, frame)]
    if not isinstance(node, dict):
        return []
    sides = [node.get("left"), node.get("right")] if "left" in node else [node.get("arg") or node.get("col")]
    names = [x.get("col") if isinstance(x, dict) else x for x in sides]
    kinds = [k for n in names if isinstance(n, str) for c, k in frame.kinds.items() if c.lower() == n.lower()]
    said = [x.get("value") for x in sides if isinstance(x, dict) and x.get("type") == "lit"] + list(node.get("values") or [] if node.get("op") in ("in", "notIn") else [])
    known = {m.lower() for k in kinds for m in k.members or ()}
    odd = known and any(isinstance(v, str) and v.lower() not in known for v in said)
    return ["W_CATEGORICAL_LITERAL_NOT_IN_DOMAIN"] * bool(odd) + [w for n in node.values() for w in _unlikely(n, frame)]


def _text_numbers(step: dict, frame: Frame, env: Environment) -> list[str]:
    """Warns of sums over numbers that their home stores as text."""
    used = {m.get("of", "").lower() for m in step.get("measures", []) if m.get("fn") in ("sum", "avg")}
    homes = [home for c, home in frame.origin.items() if c.lower() in used]
    return ["W_NUMBERS_STORED_AS_TEXT"] * any(column in env.entity(name).text_numbers for name, column in homes)


def _fit_template(frame: Frame, plan: dict, env: Environment) -> list[str]:
    """The result's columns must be the template's writable ones, in order and of their types."""
    template = env.templates.get(plan["sink"]["templateId"])
    if template is None:
        raise PlanError("E_TEMPLATE_UNKNOWN", f"there is no template {plan['sink']['templateId']!r}", "/sink/templateId", list(env.templates), plan["sink"]["templateId"])
    if plan["steps"] and plan["steps"][-1]["op"] == "pivot":
        raise PlanError("E_TEMPLATE_DYNAMIC_COLUMNS", "a pivot's columns are not known before it runs", "/sink")
    wanted, have = [c for c in template if not c.formula], list(frame.kinds)
    names = [c.name for c in wanted]
    if extra := [h for h in have if h not in names]:
        raise PlanError("E_TEMPLATE_EXTRA_COLUMN", f"not in the template: {', '.join(extra)}", "/sink")
    if missing := [n for n in names if n not in have]:
        raise PlanError("E_TEMPLATE_COLUMN_MISSING", f"missing: {', '.join(missing)}", "/sink")
    if have != names:
        raise PlanError("E_TEMPLATE_COLUMN_ORDER", f"the order is {', '.join(names)}", "/sink")
    last = plan["steps"][-1] if plan["steps"] else {}
    said = {c["as"]: c["expr"] for c in last.get("columns", [])}
    warnings = []
    for c in wanted:
        kind, expr = frame.kinds[c.name], said.get(c.name, {})
        if expr.get("type") == "toText" and c.base != "text":
            raise PlanError("E_TOTEXT_OUTSIDE_CONCAT", f"{c.name!r} is no text column", "/sink")
        if expr.get("type") == "lit" and expr.get("value") is None:
            warnings.append("W_UNMAPPED_TEMPLATE_COLUMN")
        elif kind.base != c.base:
            raise PlanError("E_TEMPLATE_TYPE_INCOMPATIBLE", f"{c.name!r} takes {c.base}, not {kind.base}", "/sink")
        if c.allowed and kind.members and set(kind.members) - set(c.allowed):
            raise PlanError("E_TEMPLATE_VALUE_NOT_IN_LIST", f"{c.name!r} allows {', '.join(c.allowed)}", "/sink")
    return list(dict.fromkeys(warnings))


def _compile_edit(plan: dict, env: Environment, params: dict | None) -> Result:
    try:
        entity = env.entity(plan["target"])
    except PlanError as e:
        raise PlanError.of([_placed(e, plan, "")]) from None
    if not plan["ops"]:
        raise PlanError("E_EDIT_EMPTY", "an edit has one operation at least", "/ops")
    frame, impact = Frame.of(entity), Impact(untraceable=env.untraceable)
    values = _parameters(plan, params)
    for i, op in enumerate(plan["ops"]):
        try:
            frame = EDITS[op["op"]](frame, op, values, entity, impact)
        except PlanError as e:
            raise PlanError.of([_placed(e, op, f"/ops/{i}")]) from None
    warnings = (["W_DEPENDENTS_NEED_CONSENT"] if impact.needs_consent else []) + (["W_OVERWRITES_FORMULAS"] if impact.formulas_overwritten else [])
    if env.untraceable and (impact.removed or impact.removes_rows):
        warnings.append("W_UNTRACEABLE_REFERENCES")
    return Result(frame, plan, warnings, impact, params)


@dataclass
class Issue:
    """Something met while the plan ran; a blocking one stops the commit."""

    code: str
    count: int
    message: str = ""

    @property
    def blocking(self) -> bool:
        return self.code in BLOCKING


@dataclass
class Preview:
    """The first rows, the whole result's size and what the run met, all from one job.

    extent: rows and columns with the header; errors: error cells of the result by column.
    """

    rows: list
    count: int
    extent: tuple[int, int]
    errors: dict[str, int]
    issues: list[Issue]
    plan_hash: str


def preview(result: Result, rows: int = 50, path: str | None = None, env: Environment | None = None) -> Preview:
    """Run the plan once; with ``path`` and ``env`` also tell which tables the result would replace there."""
    frame, seen, place = result.frame, Observation(), "__at"
    counts = [F.count(F.lit(1)).alias("rows"), *[F.count(F.col(f"`{ERROR}{c}`")).alias(c) for c in sorted(frame.errors)]]
    # Numbered in the result's own order; the first rows by that number need a look at all of them, so all are counted.
    numbered = frame.df.observe(seen, *counts).withColumn(place, F.monotonically_increasing_id())
    first = numbered.orderBy(place).limit(max(1, rows)).select(*[f"`{c}`" for c in frame.kinds]).collect()[:rows]
    got = dict(seen.get)
    count, errors = got.pop("rows"), {k: v for k, v in got.items() if v}
    issues = [Issue("LOAD_NOTE", n, note) for note, n in result.notes]
    met: dict[str, int] = {}
    for code, observed in frame.seen:
        met[code] = met.get(code, 0) + (observed.get["n"] or 0)
    issues += [Issue(code, n) for code, n in met.items() if n]
    issues += [Issue("ERRORS_IN_OUTPUT", sum(errors.values()), ", ".join(errors))] if errors else []
    issues += _replaced(result, path, env) if path and env else []
    return Preview(first, count, (count + 1, len(frame.kinds)), errors, issues, result.plan_hash)


def content_hash(df: DataFrame) -> str:
    """A hash of the table whatever the order of its rows, in one pass: names and types, row count, sum and xor of row hashes.

    A row's hash is of each column's place, of whether it is null, and of its value, so nothing can change places unseen.
    """
    parts = [x for i, c in enumerate(df.columns) for x in (F.lit(i), F.col(f"`{c}`").isNull(), F.col(f"`{c}`").cast("string"))]
    row = F.xxhash64(*parts)
    n, total, xor = df.agg(F.count(F.lit(1)), F.sum(row.cast("decimal(38,0)")), F.bit_xor(F.xxhash64(F.lit(1), *parts))).first()
    shape = hashlib.sha256(repr([(f.name, f.dataType.simpleString()) for f in df.schema]).encode()).hexdigest()[:16]
    return f"{shape}:{n}:{total or 0}:{xor or 0}"


def guards(env: Environment, names: list[str]) -> dict[str, str]:
    return {n: content_hash(env.entity(n).df) for n in names}


def consent(result: Result, on_dependents: str = "block") -> None:
    """Edits that others depend on need their user's word."""
    if result.impact and result.impact.needs_consent and on_dependents != "convertToValues":
        raise PlanError("E_DROP_HAS_DEPENDENTS", f"others depend on: {', '.join(sorted({c or 'rows' for c, *_ in result.impact.needs_consent}))}")


def check_params(declared: list[dict], given: dict | None) -> None:
    """Each declared parameter has a value of its type, and there are no others."""
    values = {k.lower(): v for k, v in (given or {}).items()}
    for p in declared:
        name, kind = p["name"], p["valueType"]
        if name.lower() not in values:
            raise PlanError("E_PARAM_MISSING", f"{name!r} needs a {kind}")
        value = values.pop(name.lower())
        number = isinstance(value, int | float) and not isinstance(value, bool)
        fits = {"number": number, "boolean": isinstance(value, bool)}.get(kind, isinstance(value, str))
        if fits and kind in ("date", "datetime"):
            try:
                (dt.date if kind == "date" else dt.datetime).fromisoformat(value)
            except ValueError:
                fits = False
        if not fits:
            raise PlanError("E_PARAM_TYPE", f"{name!r} is a {kind}, not {value!r}")
    if values:
        raise PlanError("E_UNKNOWN_PARAM", f"not declared: {', '.join(sorted(values))}")


def check_new_sheet(name: str | None, anchor: str | None, taken: tuple[str, ...]) -> None:
    """A new sheet has a valid name that is free, and begins at one cell."""
    if not (name or "").strip():
        raise PlanError("E_SINK_NEW_SHEET_NAME_MISSING", "a new sheet needs a name", "/sink")
    if len(name) > NAME_LENGTH or re.search(FORBIDDEN, name) or name[0] == "'" or name[-1] == "'" or name.lower() == RESERVED:
        raise PlanError("E_SINK_SHEET_NAME_INVALID", f"{name!r} can't name a sheet", "/sink")
    if name.lower() in {t.lower() for t in taken}:
        raise PlanError("E_SINK_SHEET_NAME_TAKEN", f"there is a sheet {name!r}", "/sink")
    check_anchor(anchor)


def check_anchor(anchor: str | None) -> None:
    if not re.fullmatch(CELL, anchor or ""):
        raise PlanError("E_SINK_ANCHOR_INVALID", f"{anchor!r} is not a cell", "/sink")


def _sources(plan: dict) -> set[str]:
    """Names of the tables that a plan reads."""
    return {plan.get("source") or plan.get("target"), *[s["with"] for s in plan.get("steps", []) if "with" in s]}


def _place(path: str) -> str:
    return unquote(urlparse(path).path).rstrip("/") + "/"


def _replaced(result: Result, path: str, env: Environment) -> list[Issue]:
    """The tables with files where the result would go: those that it reads stop it, others are told."""
    if (result.plan.get("sink") or {}).get("mode") == "newSheet":
        return []
    target, read = _place(path), {n.lower() for n in _sources(result.plan)}
    out = []
    for name, e in env.entities.items():
        if any(_place(f).startswith(target) or target.startswith(_place(f)) for f in e.df.inputFiles()):
            out.append(Issue("OVERWRITES_SOURCE" if name.lower() in read else "OVERWRITES_TABLE", 0, name))
    return out


def refuse_sources(result: Result, path: str, env: Environment) -> None:
    """A result never replaces files that it is read from: they would be gone before they are read."""
    for issue in _replaced(result, path, env):
        if issue.blocking:
            raise PlanError(issue.code, f"{path!r} holds rows of {issue.message!r}")


def commit(result: Result, path: str | None, env: Environment, expected_hash: str, seen: dict[str, str] | None = None, on_dependents: str = "block", format: str = "parquet") -> None:
    """Write the result, if the plan is the one shown and no source has changed since ``seen``.

    A new sheet is a path that doesn't exist yet; an anchor or a template replaces what is there,
    but never a source of the plan.
    """
    if result.plan_hash != expected_hash:
        raise PlanError("E_COMMIT_PLAN_MISMATCH", "the plan is not the one that was shown")
    if not path:
        raise PlanError("E_SINK_ANCHOR_MISSING", "no place was chosen for the result")
    consent(result, on_dependents)
    check_params(result.plan.get("params") or [], result.params)
    refuse_changed(result, env)
    if result.frame.seen:  # only plans that may meet something need to be run before they are written
        for issue in preview(result, 0).issues:
            if issue.blocking:
                raise PlanError(issue.code, f"met {issue.count} times; see the preview")
    if seen is not None and guards(env, list(seen)) != seen:
        raise PlanError("E_COMMIT_SOURCE_CHANGED", "a source has changed since the preview")
    mode = "errorifexists" if result.plan.get("sink", {}).get("mode") == "newSheet" else "overwrite"
    if mode == "overwrite":
        refuse_sources(result, path, env)
    writer = result.df.write.mode(mode)
    (writer.option("header", True) if format == "csv" else writer).format(format).save(path)


def sheet_name(wanted: str | None, taken: tuple[str, ...]) -> str:
    """A valid name that is still free; what sheets forbid is left out."""
    clean = re.sub(FORBIDDEN, "", wanted or "").strip().strip("'")
    clean = ("Result" if not clean.strip() or clean.lower() == RESERVED else clean)[:NAME_LENGTH]
    name, n = clean, 2
    while name.lower() in {t.lower() for t in taken}:
        end = f" {n}"
        name, n = clean[: NAME_LENGTH - len(end)] + end, n + 1
    return name


def entity(name: str, df: DataFrame, **more) -> Entity:
    return Entity(name, df, **more)


__all__ = ["RID", "Issue", "Preview", "Report", "Result", "check", "check_anchor", "check_new_sheet", "check_params", "commit", "compile_plan", "consent", "content_hash", "entity", "guards", "parse", "plan_hash", "preview", "sheet_name"]
