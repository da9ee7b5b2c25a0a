"""Plans written as Python: values and conditions with operators, steps as chained methods.

``Query("orders").filter(col("o_totalprice") > 100).sort("-o_totalprice").limit(3).plan`` is the
plan's JSON.  Nothing is checked here; the compiler does that.
"""

from __future__ import annotations

import datetime as dt
from typing import Any


class Value:
    """An expression; operators make larger ones, comparisons make conditions."""

    def __init__(self, **json: Any):
        self.json = json

    def __add__(self, other):
        return _two("add", self, other)

    def __radd__(self, other):
        return _two("add", other, self)

    def __sub__(self, other):
        return _two("sub", self, other)

    def __rsub__(self, other):
        return _two("sub", other, self)

    def __mul__(self, other):
        return _two("mul", self, other)

    def __rmul__(self, other):
        return _two("mul", other, self)

    def __truediv__(self, other):
        return _two("div", self, other)

    def ratio(self, other):
        return Value(type="ratio", numerator=self.json, denominator=as_json(other))

    def pct(self, other):
        return Value(type="pct", numerator=self.json, denominator=as_json(other))

    def __eq__(self, other):
        return self._than("eq", other)

    def __ne__(self, other):
        return self._than("ne", other)

    def __lt__(self, other):
        return self._than("lt", other)

    def __le__(self, other):
        return self._than("lte", other)

    def __gt__(self, other):
        return self._than("gt", other)

    def __ge__(self, other):
        return self._than("gte", other)

    __hash__ = None

    def _than(self, op: str, other) -> Condition:
        return Condition(op=op, left=self.json, right=as_json(other))

    def among(self, *values):
        return Condition(op="in", col=self.json["col"], values=list(values))

    def outside(self, *values):
        return Condition(op="notIn", col=self.json["col"], values=list(values))

    def is_blank(self):
        return Condition(op="isNull", col=self.json["col"])

    def is_filled(self):
        return Condition(op="isNotNull", col=self.json["col"])

    def part(self, name: str):
        """year, quarter, month, isoWeek, day or isoDayOfWeek."""
        return Value(type=name if name == "isoDayOfWeek" else name + "Of", col=self.json["col"])

    def bucket(self, breaks: list[float], labels: list[str]):
        return Value(type="bucket", col=self.json["col"], breaks=breaks, labels=labels)

    def or_else(self, *others):
        return Value(type="coalesce", args=[self.json, *map(as_json, others)])

    def text(self, change: str):
        """trim, upper or lower."""
        return Value(type=change, arg=self.json)

    def split(self, separator: str, nth: int):
        return Value(type="splitPart", arg=self.json, sep=separator, index=nth)

    def shown(self, pattern: str):
        return Value(type="toText", arg=self.json, pattern=pattern)


class Condition:
    def __init__(self, **json: Any):
        self.json = json

    def __and__(self, other):
        return Condition(op="and", clauses=[self.json, other.json])

    def __or__(self, other):
        return Condition(op="or", clauses=[self.json, other.json])

    def __invert__(self):
        return Condition(op="not", clause=self.json)


def as_json(x: Any) -> dict:
    """JSON of a value or condition; other things become literals, dates those of their day."""
    if isinstance(x, Value | Condition):
        return x.json
    if isinstance(x, dt.date):
        return {"type": "lit", "value": x.isoformat(), "valueType": "datetime" if isinstance(x, dt.datetime) else "date"}
    return {"type": "lit", "value": x}


def _two(kind: str, a: Any, b: Any) -> Value:
    return Value(type=kind, a=as_json(a), b=as_json(b))


def col(name: str) -> Value:
    return Value(type="col", col=name)


def value(x: Any) -> Value:
    return Value(**as_json(x))


def given(name: str) -> Value:
    """A parameter."""
    return Value(type="param", name=name)


def choose(*branches: tuple[Condition, Any], otherwise: Any = None) -> Value:
    return Value(type="case", when=[{"if": p.json, "then": as_json(v)} for p, v in branches], **{"else": as_json(otherwise)})


def joined(*parts: Any, sep: str | None = None, skip_blanks: bool = False) -> Value:
    more = ({"sep": sep} if sep is not None else {}) | ({"skipNulls": True} if skip_blanks else {})
    return Value(type="concat", parts=[as_json(p) for p in parts], **more)


def total_of(measure: str) -> Value:
    return Value(type="sumAll", col=measure)


def measure(fn: str, of: str = "*", where: Condition | None = None) -> dict:
    return {"fn": fn, "of": of} | ({"where": where.json} if where is not None else {})


class _Chain:
    list_name: str

    def __init__(self, **head: Any):
        self.plan = head

    def _and(self, **step: Any):
        out = type(self).__new__(type(self))
        out.plan = self.plan | {self.list_name: [*self.plan[self.list_name], step]}
        return out

    def parameters(self, **types: str):
        out = type(self).__new__(type(self))
        out.plan = self.plan | {"params": [{"name": n, "valueType": t} for n, t in types.items()]}
        return out


class Query(_Chain):
    list_name = "steps"

    def __init__(self, source: str, **sink: Any):
        super().__init__(kind="query", source=source, steps=[], sink=sink or {"mode": "newSheet", "name": "Result"}, params=[])

    def filter(self, p: Condition):
        return self._and(op="filter", predicate=p.json)

    def derive(self, **columns: Any):
        out = self
        for name, v in columns.items():
            out = out._and(op="derive", expr=as_json(v), **{"as": name})
        return out

    def project(self, *names: str, **columns: Any):
        """Columns as they are, then computed ones; a text names a column."""
        all_columns = {n: n for n in names} | columns
        return self._and(op="project", columns=[{"as": n, "expr": as_json(col(v) if isinstance(v, str) else v)} for n, v in all_columns.items()])

    def aggregate(self, *groups: str, **measures: dict):
        return self._and(op="aggregate", groupBy=list(groups), measures=[m | {"as": n} for n, m in measures.items()])

    def sort(self, *keys: str):
        """``-name`` sorts downwards."""
        return self._and(op="sort", by=[{"col": k.removeprefix("-"), "dir": "desc" if k[0] == "-" else "asc"} for k in keys])

    def limit(self, n: int):
        return self._and(op="limit", n=n)

    def join(self, entity: str, left: str, right: str, kind: str = "inner"):
        return self._and(op="join", on={"left": left, "right": right}, kind=kind, **{"with": entity})

    def lookup(self, entity: str, left: str, right: str, *take: str):
        return self._and(op="lookup", on={"left": left, "right": right}, **{"with": entity}, **({"take": list(take)} if take else {}))

    def pivot(self, rows: list[str], columns: str, values: str):
        return self._and(op="pivot", rows=rows, cols=columns, values=values)

    def compare(self, metric: str, dimension: str, grain: str, current: str, prior: str, *groups: str):
        more = {"groupBy": list(groups)} if groups else {}
        return self._and(op="periodCompare", metric=metric, timeDim=dimension, grain=grain, current=current, prior=prior, **more)


class Edit(_Chain):
    list_name = "ops"

    def __init__(self, target: str):
        super().__init__(kind="edit", target=target, ops=[], params=[])

    def add(self, name: str, v: Any, after: str | None = None, at: str = "last"):
        return self._and(op="addColumn", expr=as_json(v), position={"at": "after", "column": after} if after else {"at": at}, **{"as": name})

    def set(self, name: str, v: Any, where: Condition | None = None):
        return self._and(op="setColumn", col=name, expr=as_json(v), **({"where": where.json} if where is not None else {}))

    def drop(self, name: str):
        return self._and(op="dropColumn", col=name)

    def rename(self, name: str, to: str):
        return self._and(op="renameColumn", col=name, to=to)

    def move(self, name: str, after: str | None = None, at: str = "first"):
        return self._and(op="moveColumn", col=name, position={"at": "after", "column": after} if after else {"at": at})

    def drop_rows(self, where: Condition):
        return self._and(op="dropRows", where=where.json)
