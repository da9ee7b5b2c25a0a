"""Canonical JSON: one text for equal values, whatever wrote them (RFC 8785)."""

from __future__ import annotations

import json
import math
import re
from decimal import Decimal
from typing import Any

EXACT = 2**53  # whole numbers up to here are exact as doubles


def number_text(x: float) -> str:
    """A number as ECMAScript writes it: the shortest digits, an exponent from 1e21 and below 1e-6 only."""
    if not math.isfinite(x):
        raise ValueError("numbers must be finite")
    if x == 0:
        return "0"
    sign, digits, power = Decimal(repr(float(x))).as_tuple()
    shown = "".join(map(str, digits)).rstrip("0")
    point = len(digits) + power  # digits before the point
    minus = "-" if sign else ""
    if len(shown) <= point <= 21:
        return minus + shown.ljust(point, "0")
    if 0 < point <= 21:
        return f"{minus}{shown[:point]}.{shown[point:]}"
    if -6 < point <= 0:
        return f"{minus}0.{'0' * -point}{shown}"
    return f"{minus}{shown[0]}{'.' + shown[1:] if len(shown) > 1 else ''}e{point - 1:+d}"


def text_text(x: str) -> str:
    """A text in quotes with the fewest escapes; half surrogate pairs, which UTF-8 can't hold, are escaped."""
    return re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m.group()):04x}", json.dumps(x, ensure_ascii=False))


def canonical_json(value: Any, exact_integers: bool = False) -> str:
    """JSON with keys sorted by UTF-16 code units, no spaces, and numbers by value: 5 and 5.0 are one.

    ``exact_integers`` keeps all digits of whole numbers that doubles can't hold.
    """
    inner = lambda v: canonical_json(v, exact_integers)
    if isinstance(value, dict):
        items = sorted(value.items(), key=lambda kv: kv[0].encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(f"{text_text(k)}:{inner(v)}" for k, v in items) + "}"
    if isinstance(value, list | tuple):
        return "[" + ",".join(map(inner, value)) + "]"
    if isinstance(value, bool) or value is None:
        return json.dumps(value)
    if isinstance(value, int) and (exact_integers or abs(value) <= EXACT):
        return str(value)
    if isinstance(value, int | float):
        try:
            return number_text(float(value))
        except OverflowError as e:
            raise ValueError("numbers must be finite") from e
    return text_text(value)
