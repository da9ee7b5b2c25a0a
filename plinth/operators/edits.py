"""Edits of a table in place, as lazy frames, and what they touch."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import ERROR, Entity, Frame, PlanError
from ..plans.expressions import Compiler, Val, family


@dataclass
class Impact:
    """Names are those that columns had before the edits; ``needs_consent``: (column or "", who depends on it, cause);
    ``untraceable``: something refers to tables in a way that can't be followed, so there may be more dependents."""

    added: list[str] = field(default_factory=list)
    removed: list[str] = field(default_factory=list)
    overwritten: list[str] = field(default_factory=list)
    renamed: list[tuple[str, str]] = field(default_factory=list)
    moved: list[str] = field(default_factory=list)
    removes_rows: bool = False
    formulas_overwritten: list[str] = field(default_factory=list)
    needs_consent: list[tuple[str, str, str]] = field(default_factory=list)
    untraceable: bool = False
    removed_rows: DataFrame | None = None  # one row: n, how many rows go (lazy)

    def rows_removed(self) -> int:
        """How many rows go, by a job of its own."""
        return self.removed_rows.first()["n"] if self.removed_rows is not None else 0


def _reorder(frame: Frame, names: list[str]) -> Frame:
    return replace(frame, kinds={n: frame.kinds[n] for n in names})


def _placed(frame: Frame, column: str, position: dict) -> Frame:
    rest = [c for c in frame.kinds if c != column]
    if position["at"] == "first":
        at = 0
    elif position["at"] == "last":
        at = len(rest)
    else:
        after = frame.name(position["column"], "E_EDIT_UNKNOWN_COLUMN")
        if after == column:
            raise PlanError("E_INVALID_ARGUMENT", "a column can't move behind itself")
        at = rest.index(after) + 1
    return _reorder(frame, [*rest[:at], column, *rest[at:]])


def _origin(frame: Frame, column: str) -> str:
    return frame.origin.get(column, ("", column))[1]


def add_column(frame: Frame, op: dict, params: dict, entity: Entity, impact: Impact) -> Frame:
    from .steps import put

    if op["as"].lower() in {c.lower() for c in frame.kinds}:
        raise PlanError("E_EDIT_COLUMN_COLLISION", f"a column named {op['as']!r} exists")
    impact.added.append(op["as"])
    return _placed(put(frame, op["as"], Compiler(frame, params).expr(op["expr"])), op["as"], op["position"])


def set_column(frame: Frame, op: dict, params: dict, entity: Entity, impact: Impact) -> Frame:
    from .steps import put

    own = frame.name(op["col"], "E_EDIT_UNKNOWN_COLUMN")
    compiler, old = Compiler(frame, params), Compiler(frame, params).column(own)
    v = compiler.expr(op["expr"])
    if v.kind.base != "null" and family(v.kind) != family(old.kind):
        raise PlanError("E_TYPE_MISMATCH", f"{own!r} holds {old.kind.base}, not {v.kind.base}")
    if not v.literal and v.kind.role == "currency" and v.kind.unit != old.kind.unit:
        raise PlanError("E_CURRENCY_UNIT_MISMATCH", f"{own!r} is in {old.kind.unit}, not {v.kind.unit}")
    value, error = v.value.cast(frame.df.schema[own].dataType), v.error
    if op.get("where"):
        where = compiler.predicate(op["where"])
        value = F.when(where, value).otherwise(old.value)
        none = F.lit(None).cast("string")
        if error is not None or old.error is not None:
            error = F.when(where, none if error is None else error).otherwise(none if old.error is None else old.error)
    impact.overwritten.append(_origin(frame, own))
    if own in entity.formulas:
        impact.formulas_overwritten.append(own)
    out = put(replace(frame, df=frame.df.drop(ERROR + own)) if error is None else frame, own, Val(value, replace(old.kind, canonical=False, members=None), error))
    return _reorder(out, list(frame.kinds))


def drop_column(frame: Frame, op: dict, params: dict, entity: Entity, impact: Impact) -> Frame:
    own = frame.name(op["col"], "E_EDIT_UNKNOWN_COLUMN")
    if len(frame.kinds) == 1:
        raise PlanError("E_EDIT_DROPS_EVERY_COLUMN", "a table keeps a column at least")
    name = _origin(frame, own)
    if name in impact.added:
        impact.added.remove(name)
    else:
        impact.removed.append(name)
        impact.needs_consent += [(c, d, "columnRemoved") for c, d in entity.dependents if c.lower() == name.lower()]
    return replace(frame, df=frame.df.drop(own, ERROR + own), kinds={c: k for c, k in frame.kinds.items() if c != own}, errors=frame.errors - {own}, origin={c: o for c, o in frame.origin.items() if c != own})


def rename_column(frame: Frame, op: dict, params: dict, entity: Entity, impact: Impact) -> Frame:
    own, to = frame.name(op["col"], "E_EDIT_UNKNOWN_COLUMN"), op["to"]
    if to.lower() in {c.lower() for c in frame.kinds if c != own}:
        raise PlanError("E_RENAME_COLLISION", f"a column named {to!r} exists")
    impact.renamed.append((_origin(frame, own), to))
    new = lambda c: to if c == own else c
    df = frame.df.withColumnsRenamed({own: to, ERROR + own: ERROR + to})
    return replace(frame, df=df, kinds={new(c): k for c, k in frame.kinds.items()}, errors=frozenset(map(new, frame.errors)), origin={new(c): o for c, o in frame.origin.items()})


def move_column(frame: Frame, op: dict, params: dict, entity: Entity, impact: Impact) -> Frame:
    own = frame.name(op["col"], "E_EDIT_UNKNOWN_COLUMN")
    impact.moved.append(_origin(frame, own))
    return _placed(frame, own, op["position"])


def drop_rows(frame: Frame, op: dict, params: dict, entity: Entity, impact: Impact) -> Frame:
    impact.removes_rows = True
    keep = ~F.coalesce(Compiler(frame, params).predicate(op["where"]), F.lit(False))  # an unknown answer keeps the row
    # What reads whole columns is meant to change with the rows; what names fixed rows could break.
    impact.needs_consent += [x for d in entity.row_dependents if (x := ("", d, "rowsRemoved")) not in impact.needs_consent]
    gone = frame.df.agg(F.count_if(~keep).alias("n"))
    impact.removed_rows = gone if impact.removed_rows is None else impact.removed_rows.unionByName(gone).agg(F.sum("n").alias("n"))
    return replace(frame, df=frame.df.filter(keep))


EDITS = {"addColumn": add_column, "setColumn": set_column, "dropColumn": drop_column, "renameColumn": rename_column, "moveColumn": move_column, "dropRows": drop_rows}
