"""What plans are made of: the fields of each part, and a check of a plan's JSON against them.

A part is written as ``name:kind`` for each field, ``name?:kind`` for one that may be missing.
Kinds: text, number, whole, flag, scalar, ``a|b`` (one of these words), ``[kind]`` (a list) or a
part; a part with variants has a field that says which.
"""

from __future__ import annotations

import json
import re
from typing import Any

from ..model import Diagnostic, PlanError

_TWO, _SIDES = "a:expression b:expression", "left:operand right:operand"
#: The wire format (fixed names).
PARTS = {
    "parameter": "name:text valueType:string|number|boolean|date|datetime",
    "column": "as:text expr:expression", "measure": "fn:count|countDistinct|countIf|sum|avg|min|max of:text as:text where?:predicate",
    "sort key": "col:text dir?:asc|desc", "pair": "left:text right:text", "branch": "if:predicate then:expression",
}
VARIANTS = {
    "plan": ("kind", {"query": "source:text steps:[step] sink:sink params?:[parameter]", "edit": "target:text ops:[edit] params?:[parameter]"}),
    "sink": ("mode", {"newSheet": "name?:text", "anchor": "", "template": "templateId:text"}),
    "step": ("op", {
        "filter": "predicate:predicate", "derive": "as:text expr:expression", "project": "columns:[column]", "aggregate": "groupBy:[text] measures:[measure]",
        "sort": "by:[sort key]", "limit": "n:whole", "join": "with:text on:pair kind?:inner|left", "lookup": "with:text on:pair take?:[text]", "pivot": "rows:[text] cols:text values:text",
        "periodCompare": "metric:text timeDim:text grain:year|quarter|month|week|day current:text prior:text groupBy?:[text]",
    }),
    "edit": ("op", {
        "addColumn": "as:text expr:expression position:position", "setColumn": "col:text expr:expression where?:predicate", "dropColumn": "col:text",
        "renameColumn": "col:text to:text", "moveColumn": "col:text position:position", "dropRows": "where:predicate",
    }),
    "position": ("at", {"first": "", "last": "", "after": "column:text"}),
    "expression": ("type", {
        "col": "col:text", "lit": "value:scalar valueType?:date|datetime", "param": "name:text", **dict.fromkeys(("add", "sub", "mul", "div"), _TWO),
        **dict.fromkeys(("ratio", "pct"), "numerator:expression denominator:expression"),
        **dict.fromkeys(("yearOf", "quarterOf", "monthOf", "isoWeekOf", "dayOf", "isoDayOfWeek", "sumAll"), "col:text"), "bucket": "col:text breaks:[number] labels:[text]",
        "coalesce": "args:[expression]", "case": "when:[branch] else:expression", "concat": "parts:[expression] sep?:text skipNulls?:flag", **dict.fromkeys(("trim", "upper", "lower"), "arg:expression"),
        "splitPart": "arg:expression sep:text index:whole", "toText": "arg:expression pattern:text",
    }),
    "operand": ("type", {"col": "col:text", "lit": "value:scalar valueType?:date|datetime", "param": "name:text"}),
    "predicate": ("op", {
        **dict.fromkeys(("eq", "ne", "lt", "lte", "gt", "gte"), _SIDES), **dict.fromkeys(("in", "notIn"), "col:text values:[scalar]"),
        **dict.fromkeys(("isNull", "isNotNull"), "col:text"), **dict.fromkeys(("and", "or"), "clauses:[predicate]"), "not": "clause:predicate",
    }),
}
_SCALARS = {
    "text": lambda x: isinstance(x, str), "flag": lambda x: isinstance(x, bool), "whole": lambda x: isinstance(x, int) and not isinstance(x, bool),
    "number": lambda x: isinstance(x, int | float) and not isinstance(x, bool), "scalar": lambda x: x is None or isinstance(x, str | int | float),
}


def _step_into(pointer: str, name: str | int) -> str:
    return f"{pointer}/{str(name).replace('~', '~0').replace('/', '~1')}"


def problems(x: Any, kind: str = "plan", at: str = "") -> list[Diagnostic]:
    """All that is wrong with a part's shape: in each place unknown fields, then missing ones, then what is inside."""
    if kind.startswith("["):
        if not isinstance(x, list):
            return [Diagnostic("E_PARSE_INVALID_VALUE", at, "a list is needed")]
        return [d for i, v in enumerate(x) for d in problems(v, kind[1:-1], _step_into(at, i))]
    if kind in _SCALARS:
        return [] if _SCALARS[kind](x) else [Diagnostic("E_PARSE_INVALID_VALUE", at, f"{x!r} is no {kind}")]
    if "|" in kind:
        words = kind.split("|")
        return [] if x in words else [Diagnostic("E_PARSE_INVALID_VALUE", at, f"{x!r} is not one of these", names=words, wanted=str(x))]
    if not isinstance(x, dict):
        return [Diagnostic("E_PARSE_INVALID_VALUE", at, f"an object ({kind}) is needed")]
    told, fields = None, PARTS.get(kind)
    if fields is None:
        told, variants = VARIANTS[kind]
        if told not in x:
            return [Diagnostic("E_PARSE_MISSING_FIELD", _step_into(at, told), f"{told!r} says which {kind} this is")]
        if x[told] not in variants:
            return [Diagnostic("E_PARSE_UNKNOWN_VARIANT", _step_into(at, told), f"{x[told]!r} is no {kind}", names=list(variants), wanted=str(x[told]))]
        fields = variants[x[told]]
    known = {m[1]: (m[3], bool(m[2])) for m in re.finditer(r"(\w+)(\??):((?:\[[^\]]*\]|sort key|[^ ])+)", fields)}
    out = [Diagnostic("E_PARSE_UNKNOWN_FIELD", _step_into(at, n), f"no field of {kind}", names=list(known), wanted=n) for n in x if n not in known and n != told]
    for name, (_, optional) in known.items():
        if not optional and (name not in x or (x[name] is None and name != "value")):
            case = told == "type" and x[told] == "case" and name == "else"
            out.append(Diagnostic("E_CASE_NO_ELSE" if case else "E_PARSE_MISSING_FIELD", _step_into(at, name), "missing"))
    for name, (inner, _) in known.items():
        if name in x and (x[name] is not None or inner == "scalar"):
            out += problems(x[name], inner, _step_into(at, name))
    return out


def parse(text: str | dict) -> dict:
    """A plan from JSON, with all fields that belong there and no others; PlanError holds all that is wrong."""
    if isinstance(text, str):
        try:
            text = json.loads(text)
        except ValueError as e:
            raise PlanError("E_PARSE_INVALID_JSON", str(e)) from e
    if found := problems(text):
        raise PlanError.of(found)
    return text


def pointer_to(root: Any, wanted: Any, at: str = "") -> str | None:
    """Where a part stands in a plan: the object itself, or the first text that equals ``wanted`` ignoring case."""
    same = isinstance(root, str) and isinstance(wanted, str) and root.lower() == wanted.lower()
    if root is wanted and not isinstance(root, bool | int | float | None) or same:
        return at
    inner = root.items() if isinstance(root, dict) else enumerate(root) if isinstance(root, list) else ()
    for name, v in inner:
        found = pointer_to(v, wanted, _step_into(at, name))
        if found is not None:
            return found
    return None
