"""Expressions and predicates of plans as Spark columns.

An expression gives a value column, its kind and, where it may fail, an error
column (null when it didn't).  Literals and parameters become literals once, so
Catalyst folds them and pushes comparisons to the scan.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import cells, text
from ..model import Frame, Kind, PlanError

NUMBER, TEXT = Kind("number"), Kind("text")
DIV0, VALUE = "#DIV/0!", "#VALUE!"
#: Parts of dates: function and the most distinct values (fixed values).
DATE_PARTS = {"yearOf": (F.year, None), "quarterOf": (F.quarter, 4), "monthOf": (F.month, 12), "isoWeekOf": (F.weekofyear, 53), "dayOf": (F.dayofmonth, 31), "isoDayOfWeek": (lambda c: F.weekday(c) + 1, 7)}
COMPARISONS = {"lt": "__lt__", "lte": "__le__", "gt": "__gt__", "gte": "__ge__"}


@dataclass(frozen=True)
class Val:
    value: Column
    kind: Kind
    error: Column | None = None
    literal: bool = False
    raw: object = None


def family(k: Kind) -> str:
    return "temporal" if k.base in ("date", "datetime") else k.base


def literal(value, value_type: str | None = None) -> Val:
    if value is None:
        return Val(F.lit(None), Kind("null"), literal=True)
    if value_type in ("date", "datetime"):
        try:
            parsed = dt.date.fromisoformat(value) if value_type == "date" else dt.datetime.fromisoformat(value)
        except (TypeError, ValueError) as e:
            raise PlanError("E_INVALID_ARGUMENT", f"{value!r} is not an ISO {value_type}") from e
        return Val(F.lit(parsed) if value_type == "date" else F.lit(value.replace("T", " ")).cast("timestamp_ntz"), Kind(value_type, nullable=False), literal=True, raw=value)
    if isinstance(value, bool):
        return Val(F.lit(value), Kind("bool", nullable=False), literal=True, raw=value)
    if isinstance(value, int | float):
        return Val(F.lit(float(value)), replace(NUMBER, nullable=False), literal=True, raw=value)
    return Val(F.lit(value), replace(TEXT, nullable=False), literal=True, raw=value)


class Compiler:
    """Compiles the expressions of one step against the frame before it."""

    def __init__(self, frame: Frame, params: dict[str, tuple[str, object]]):
        self.frame, self.params = frame, {k.lower(): v for k, v in params.items()}
        self.depth = 0  # of concat

    def column(self, name: str) -> Val:
        own = self.frame.name(name)
        return Val(F.col(f"`{own}`"), self.frame.kinds[own], self.frame.error(own))

    def _at(self, node: dict, compile_it):
        """What ``compile_it`` makes of a node; an error remembers the innermost one."""
        try:
            return compile_it(node)
        except PlanError as e:
            e.node = e.node if e.node is not None else node
            raise

    def expr(self, e: dict) -> Val:
        return self._at(e, self._date_part if e["type"] in DATE_PARTS else getattr(self, "_" + e["type"]))

    def _col(self, e):
        return self.column(e["col"])

    def _lit(self, e):
        return literal(e["value"], e.get("valueType"))

    def _param(self, e):
        if e["name"].lower() not in self.params:
            raise PlanError("E_UNKNOWN_PARAM", f"parameter {e['name']!r} is not declared", names=list(self.params), wanted=e["name"])
        value_type, value = self.params[e["name"].lower()]
        if value is None:
            base = {"string": "text", "boolean": "bool"}.get(value_type, value_type)
            return Val(F.lit(None), Kind(base), literal=True)
        return literal(value, value_type if value_type in ("date", "datetime") else None)

    def _numbers(self, a: dict, b: dict) -> tuple[Val, Val]:
        x, y = self.expr(a), self.expr(b)
        for v in (x, y):
            if v.kind.base not in ("number", "null"):
                raise PlanError("E_TYPE_MISMATCH", f"numbers are needed, not {v.kind.base}")
        return x, y

    @staticmethod
    def _errors(*vals: Val, own: Column | None = None) -> Column | None:
        found = [v.error for v in vals if v.error is not None] + ([own] if own is not None else [])
        return F.coalesce(*found) if len(found) > 1 else found[0] if found else None

    def _add(self, e):
        return self._sum(e, "__add__")

    def _sub(self, e):
        return self._sum(e, "__sub__")

    def _sum(self, e, op):
        a, b = self._numbers(e["a"], e["b"])
        if a.kind.role == b.kind.role == "currency" and a.kind.unit != b.kind.unit:
            raise PlanError("E_CURRENCY_UNIT_MISMATCH", f"{a.kind.unit} and {b.kind.unit} can't be added")
        if not (a.literal or b.literal) and a.kind.role != b.kind.role:
            raise PlanError("E_TYPE_MISMATCH", f"{a.kind.role or 'number'} and {b.kind.role or 'number'} can't be added")
        kind = (b if a.literal else a).kind
        return Val(getattr(a.value.cast("double"), op)(b.value.cast("double")), _plain(kind, a, b), self._errors(a, b))

    def _mul(self, e):
        a, b = self._numbers(e["a"], e["b"])
        roles = [v.kind.role for v in (a, b)]
        if roles == ["currency", "currency"]:
            raise PlanError("E_TYPE_MISMATCH", "two amounts of money can't be multiplied")
        money = next((v.kind for v in (a, b) if v.kind.role == "currency"), NUMBER)
        return Val(a.value.cast("double") * b.value.cast("double"), _plain(money, a, b), self._errors(a, b))

    def _divided(self, a: Val, b: Val, kind: Kind) -> Val:
        top, bottom = a.value.cast("double"), b.value.cast("double")
        own = None if b.literal and b.raw else F.when(top.isNotNull() & (bottom == 0), F.lit(DIV0))
        return Val(F.try_divide(top, bottom), replace(kind, nullable=True), self._errors(a, b, own=own))

    def _div(self, e):
        a, b = self._numbers(e["a"], e["b"])
        if b.kind.role == "currency" and a.kind.role != "currency":
            raise PlanError("E_TYPE_MISMATCH", "a number can't be divided by money")
        if a.kind.role == b.kind.role == "currency" and a.kind.unit != b.kind.unit:
            raise PlanError("E_CURRENCY_UNIT_MISMATCH", f"{a.kind.unit} can't be divided by {b.kind.unit}")
        return self._divided(a, b, NUMBER if b.kind.role == "currency" else replace(a.kind, order=None, members=None))

    def _ratio(self, e):
        return self._divided(*self._numbers(e["numerator"], e["denominator"]), NUMBER)

    def _pct(self, e):
        return self._divided(*self._numbers(e["numerator"], e["denominator"]), Kind("number", "percent"))

    def _date_part(self, e):
        v = self.column(e["col"])
        if family(v.kind) != "temporal":
            raise PlanError("E_DATE_EXTRACT_NON_DATE", f"{e['col']!r} is not a date")
        function, bound = DATE_PARTS[e["type"]]
        return Val(function(v.value), Kind("number", bound=bound, nullable=v.kind.nullable), v.error)

    def _bucket(self, e):
        v, breaks, labels = self.column(e["col"]), e["breaks"], e["labels"]
        if v.kind.base != "number":
            raise PlanError("E_TYPE_MISMATCH", "only numbers fall in buckets")
        if len(labels) != len(breaks) + 1:
            raise PlanError("E_BUCKET_BREAK_COUNT", f"{len(breaks)} breaks need {len(breaks) + 1} labels")
        if sorted(set(breaks)) != list(breaks):
            raise PlanError("E_INVALID_ARGUMENT", "breaks must rise")
        out = F.when(v.value < breaks[0], labels[0])
        for b, name in zip(breaks[1:], labels[1:], strict=False):
            out = out.when(v.value < b, name)
        out = out.when(v.value.isNotNull(), labels[-1])
        return Val(out, Kind("text", "categorical", members=tuple(labels), order=tuple(labels), bound=len(labels), nullable=v.kind.nullable, canonical=True), v.error)

    def _coalesce(self, e):
        vals = [self.expr(a) for a in e["args"]]
        kinds = [v.kind for v in vals if v.kind.base != "null"]
        if len({family(k) for k in kinds}) > 1:
            raise PlanError("E_TYPE_MISMATCH", "coalesce needs values of one type")
        kind = replace(kinds[0] if kinds else Kind("null"), nullable=all(v.kind.nullable for v in vals), canonical=False, members=None, order=None)
        error = None
        if any(v.error is not None for v in vals):
            error = F.lit(None).cast("string")
            for v in reversed(vals):
                error = F.when(v.value.isNull() & (F.lit(True) if v.error is None else v.error.isNull()), error).otherwise(F.lit(None) if v.error is None else v.error)
        value = F.coalesce(*[v.value for v in vals])
        if error is not None:
            value = F.when(error.isNull(), value)
        return Val(value, kind, error)

    def _case(self, e):
        branches = [(self.predicate(w["if"]), self.expr(w["then"])) for w in e["when"]]
        other = self.expr(e["else"])
        vals = [*[v for _, v in branches], other]
        kinds = [v.kind for v in vals if v.kind.base != "null"]
        if len({family(k) for k in kinds}) > 1:
            raise PlanError("E_TYPE_MISMATCH", "the branches of a case must be of one type")
        kind = replace(kinds[0], canonical=False) if kinds else Kind("null")
        if kinds and all(v.literal and v.kind.base in ("text", "null") for v in vals):
            members = tuple(dict.fromkeys(v.raw for v in vals if v.raw is not None))
            kind = Kind("text", "categorical", members=members, bound=len(members))
        kind = replace(kind, nullable=any(v.kind.nullable for v in vals))

        def pick(part):
            out = None
            for p, v in branches:
                x = part(v)
                out = F.when(p, x) if out is None else out.when(p, x)
            return part(other) if out is None else out.otherwise(part(other))

        error = pick(lambda v: F.lit(None).cast("string") if v.error is None else v.error) if any(v.error is not None for v in vals) else None
        return Val(pick(lambda v: v.value), kind, error)

    def _sumAll(self, e):  # noqa: N802
        if not self.frame.measures:
            raise PlanError("E_SUMALL_INVALID_PLACEMENT", "sumAll is for the step right after an aggregate")
        own = next((c for c in self.frame.measures if c.lower() == e["col"].lower()), None)
        if own is None:
            raise PlanError("E_SUMALL_UNKNOWN_COLUMN", f"{e['col']!r} is not a measure of the aggregate before", names=sorted(self.frame.measures), wanted=e["col"])
        # The groups, not their rows, meet for their sum; a second run of the aggregate would read the table again.
        total = F.sum(F.col(f"`{own}`").cast("double")).over(Window.partitionBy())
        return Val(total, replace(self.frame.kinds[own], nullable=False))

    def _display(self, e: dict) -> tuple[Column, Val]:
        v = self.expr(e)
        return (F.lit(None).cast("string") if v.kind.base == "null" else text.display(v.value, v.kind.base)), v

    def _concat(self, e):
        self.depth += 1
        parts = [self._display(p) for p in e["parts"]]
        self.depth -= 1
        out = text.concat([p for p, _ in parts], e.get("sep") or "", bool(e.get("skipNulls")))
        error = self._errors(*[v for _, v in parts])
        return Val(out if error is None else F.when(error.isNull(), out), replace(TEXT, nullable=all(v.kind.nullable for _, v in parts)), error)

    def _text(self, e, function):
        v = self.expr(e["arg"])
        if v.kind.base not in ("text", "null"):
            raise PlanError("E_TYPE_MISMATCH", f"{e['type']} needs text")
        return Val(function(v.value.cast("string")), replace(TEXT, nullable=v.kind.nullable), v.error)

    def _trim(self, e):
        return self._text(e, text.trim)

    def _upper(self, e):
        return self._text(e, F.upper)

    def _lower(self, e):
        return self._text(e, F.lower)

    def _splitPart(self, e):  # noqa: N802
        if e["index"] < 1 or not e["sep"]:
            raise PlanError("E_INVALID_ARGUMENT", "splitPart needs a separator and an index from 1")
        found = self._text(e, lambda c: text.split_part(c, e["sep"], e["index"]))
        return replace(found, kind=TEXT)

    def _toText(self, e):  # noqa: N802
        if not self.depth:
            raise PlanError("E_TOTEXT_OUTSIDE_CONCAT", "toText belongs in a concat or a text column of a template")
        v = self.expr(e["arg"])
        known = text.DATE_PATTERNS if family(v.kind) == "temporal" else text.NUMBER_PATTERNS if v.kind.base == "number" else {}
        if e["pattern"] not in known:
            raise PlanError("E_INVALID_ARGUMENT", f"no pattern {e['pattern']!r} for {v.kind.base}", names=list(known), wanted=e["pattern"])
        return Val(text.pattern_text(v.value, e["pattern"], v.kind.base), replace(TEXT, nullable=v.kind.nullable), v.error)

    # Predicates: a boolean column, null where an error was met.  Where a null counts as false anyhow
    # (``positive``), comparisons stay bare, so that they reach the scan.

    def predicate(self, p: dict, positive: bool = True) -> Column:
        return self._at(p, lambda node: self._predicate(node, positive))

    def _predicate(self, p: dict, positive: bool) -> Column:
        op = p["op"]
        if op in ("and", "or"):
            parts = [self.predicate(c, positive) for c in p["clauses"]]
            return reduce((lambda a, b: a & b) if op == "and" else (lambda a, b: a | b), parts)
        if op == "not":
            return ~self.predicate(p["clause"], False)
        if op in ("isNull", "isNotNull"):
            v = self.column(p["col"])
            empty = cells.blank(v.value, v.kind.text and not v.kind.canonical)
            empty = empty if v.error is None else empty & v.error.isNull()
            return empty if op == "isNull" else ~empty
        if op in ("in", "notIn"):
            return self._membership(p, positive)
        a, b = self._alike(self.expr(p["left"]), self.expr(p["right"]))
        if op in ("eq", "ne"):
            same = self._equal(a, b)
            out = same if op == "eq" else ~same
        else:
            out = self._compare(op, a, b)
            out = out if positive else cells.total(out)
        return self._known(out, a, b)

    @staticmethod
    def _known(p: Column, *vals: Val) -> Column:
        errors = [v.error.isNull() for v in vals if v.error is not None]
        return F.when(reduce(lambda a, b: a & b, errors), p) if errors else p

    @staticmethod
    def _alike(a: Val, b: Val) -> tuple[Val, Val]:
        if "null" not in (a.kind.base, b.kind.base) and family(a.kind) != family(b.kind):
            raise PlanError("E_TYPE_INCOMPARABLE", f"{a.kind.base} can't be compared with {b.kind.base}")
        if a.kind.role == b.kind.role == "currency" and a.kind.unit != b.kind.unit:
            raise PlanError("E_CURRENCY_UNIT_MISMATCH", f"{a.kind.unit} can't be compared with {b.kind.unit}")
        return a, b

    @staticmethod
    def _key(v: Val) -> Column:
        if v.literal and v.kind.text:
            return F.lit(v.raw.lower() if v.raw.strip(cells.WHITE) else None)
        return cells.key(v.value, v.kind.text)

    def _spelled(self, column: Val, value: Val) -> Val | None:
        """The literal in the column's own spelling, if the column has each value in one spelling."""
        if column.kind.canonical and column.kind.members and value.literal and value.kind.text:
            for m in column.kind.members:
                if m.lower() == value.raw.lower():
                    return replace(value, value=F.lit(m))
        return None

    def _equal(self, a: Val, b: Val) -> Column:
        known = self._spelled(a, b)
        if known is not None:
            return a.value.eqNullSafe(known.value)
        return self._key(a).eqNullSafe(self._key(b))

    def _compare(self, op: str, a: Val, b: Val) -> Column:
        for v in (a, b):
            if not v.literal and not v.kind.ordered:
                raise PlanError("E_ORDER_COMPARISON_NON_ORDERED", "less and greater need numbers, dates or a category with a declared order")
        order = next((v.kind.order for v in (a, b) if isinstance(v.kind.order, tuple)), None)
        if order is None:
            return getattr(a.value, COMPARISONS[op])(b.value)
        ranks = F.array(*[F.lit(o.lower()) for o in order])
        rank = lambda v: F.nullif(F.array_position(ranks, F.lower(v.value)), F.lit(0).cast("long"))
        return getattr(rank(a), COMPARISONS[op])(rank(b))

    def _membership(self, p: dict, positive: bool) -> Column:
        if not p["values"]:
            raise PlanError("E_INVALID_ARGUMENT", "an empty list")
        v = self.column(p["col"])
        as_type = v.kind.base if v.kind.base in ("date", "datetime") else None
        members = [self._alike(v, literal(x, as_type if isinstance(x, str) else None))[1] for x in p["values"]]
        empty = any(m.kind.base == "null" for m in members)
        named = [m for m in members if m.kind.base != "null"]
        spelled = [self._spelled(v, m) for m in named]
        subject = v.value if named and all(spelled) else cells.key(v.value, v.kind.text)
        keys = [s.value for s in spelled] if named and all(spelled) else [self._key(m) for m in named]
        found = subject.isin(*keys) if keys else F.lit(False)
        if empty:
            found = cells.total(found) | cells.blank(v.value, v.kind.text)
        if p["op"] == "notIn":
            found = ~cells.total(found)
        elif not positive:
            found = cells.total(found)
        return self._known(found, v)


def _plain(kind: Kind, *vals: Val) -> Kind:
    return replace(kind, nullable=any(v.kind.nullable for v in vals), bound=None, members=None, order=None)
