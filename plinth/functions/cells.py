"""Blank, equality, order and error rules of cells.

A blank is a null or a text of white space.  Text is equal ignoring case, and a blank
equals a blank only.  A predicate is true, false or, when it met an error, null;
a filter keeps what is true.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that text order leaves out at first (fixed values).
IGNORED_IN_ORDER = "['’-]"
BEYOND = 1_000_000_000
#: White space (fixed values): ASCII, no-break, line and paragraph ends, wide spaces, byte order mark.
WHITE = "\t\n\x0b\x0c\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is made once a row, however often ``then`` names it: large expressions stay small."""
    return F.get(F.transform(F.array(value), then), 0)


def bare(c: Column) -> Column:
    """Text without white space at its ends."""
    return F.trim(c, F.lit(WHITE))


def blank(c: Column, text: bool) -> Column:
    return (c.isNull() | (bare(c) == "")) if text else c.isNull()


def key(c: Column, text: bool) -> Column:
    """Value by which cells are equal; null for a blank."""
    return F.when(bare(c) != "", F.lower(c)) if text else c


def total(p: Column) -> Column:
    """A comparison with nulls as false, so that its negation is true there."""
    return F.coalesce(p, F.lit(False))


def order_by(c: Column, direction: str, text: bool, order: list[str] | None = None, error: Column | None = None) -> list[Column]:
    """Sort keys: blanks last both ways, errors after all values, text ignoring case, accents and some marks."""
    way = (lambda k: k.asc_nulls_last()) if direction == "asc" else (lambda k: k.desc_nulls_last())
    keys: list[Column] = []
    if error is not None:
        keys += [(c.isNull() & error.isNull()).asc(), way(error.isNotNull()), way(error)]
    if not text:
        return [*keys, way(c)]
    shown = F.when(bare(c) != "", c)
    if order:
        place = F.array_position(F.array(*[F.lit(o.lower()) for o in order]), F.lower(shown))
        keys.append(way(F.when(place > 0, place).when(shown.isNotNull(), BEYOND)))
    main = F.regexp_replace(shown, IGNORED_IN_ORDER, "")
    loose = lambda x: F.collate(x, "UNICODE_CI_AI")
    return [*keys, way(loose(main)), way(F.length(shown) - F.length(main)), way(loose(shown))]
