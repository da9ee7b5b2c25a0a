"""What plans run against: entities, links, metrics, time dimensions, templates; and frames between steps."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RID, ERROR = "__rid", "__e$"
MAX_PIVOT = 50


def _distance(a: str, b: str) -> int:
    """Least number of letters to change, add or leave out."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


class Diagnostic:
    """One thing that is wrong or odd: code, JSON pointer, message, and up to five names that may have been meant."""

    def __init__(self, code: str, at: str, message: str, names=(), wanted: str | None = None, hint: str = ""):
        self.code, self.at, self.message, self.wanted = code, at, message, wanted
        near = sorted(((_distance((wanted or "").lower(), n.lower()), n) for n in names)) if wanted is not None else []
        self.candidates = [n for _, n in near[:5]]
        close = near and near[0][0] <= max(2, len(wanted) // 3)
        self.hint = hint or (f"did you mean {near[0][1]!r}?" if close else f"known: {', '.join(names)}" if names else "")

    def __repr__(self) -> str:
        return f"{self.code}: {self.message}" + (f" (at {self.at})" if self.at else "") + (f"; {self.hint}" if self.hint else "")


class PlanError(Exception):
    """A plan that can't be checked or run; ``code`` says why, ``diagnostics`` holds all that was found."""

    def __init__(self, code: str, message: str, at: str = "", names=(), wanted: str | None = None):
        self.diagnostics, self.node = [Diagnostic(code, at, message, list(names), wanted)], None
        super().__init__(repr(self.diagnostics[0]))

    @classmethod
    def of(cls, found: list[Diagnostic]) -> PlanError:
        out = cls(found[0].code, found[0].message, found[0].at)
        out.diagnostics = found
        return out

    @property
    def code(self) -> str:
        return self.diagnostics[0].code

    @property
    def at(self) -> str:
        return self.diagnostics[0].at

    @property
    def message(self) -> str:
        return self.diagnostics[0].message


@dataclass(frozen=True)
class Kind:
    """A column's type beyond Spark's: base is number, text, date, datetime, bool or null.

    unit: of a currency; role: percent, currency or categorical; members and order: of a category
    (order is None for nominal ones, "missing" for ordinal ones whose order nobody has declared);
    bound: most distinct values; canonical: text without blanks and without spellings that differ in case only.
    """

    base: str
    role: str | None = None
    unit: str | None = None
    members: tuple[str, ...] | None = None
    order: tuple[str, ...] | str | None = None
    bound: int | None = None
    nullable: bool = True
    canonical: bool = False

    @property
    def text(self) -> bool:
        return self.base == "text"

    @property
    def ordered(self) -> bool:
        return self.base in ("number", "date", "datetime") or isinstance(self.order, tuple)


def kind_of(t: T.DataType) -> Kind:
    if isinstance(t, T.NumericType):
        return Kind("number")
    if isinstance(t, T.DateType):
        return Kind("date")
    if isinstance(t, T.TimestampType | T.TimestampNTZType):
        return Kind("datetime")
    if isinstance(t, T.BooleanType):
        return Kind("bool")
    if isinstance(t, T.NullType):
        return Kind("null")
    if isinstance(t, T.StringType):
        return Kind("text")
    raise PlanError("E_TYPE_MISMATCH", f"columns of type {t.simpleString()} can't be used in a plan")


@dataclass(frozen=True)
class Entity:
    """A named table.  ``kinds`` overrides what the schema says of a column; ``unique``: key columns;
    ``formulas``: columns that are computed where they live; ``dependents``: (column, what needs it);
    ``text_numbers``: number columns that are stored as text where they live; ``row_dependents``: what
    names fixed rows; ``order``: columns that say the order of rows; ``notes``: (what loading met, how often).

    Without ``order`` rows are in the order of Spark's partitions, which follows how files are split: what is
    first among equals (a spelling, a row of a limit without sort) can then differ between clusters."""

    name: str
    df: DataFrame
    kinds: dict[str, Kind] = field(default_factory=dict)
    unique: frozenset[str] = frozenset()
    formulas: frozenset[str] = frozenset()
    dependents: tuple[tuple[str, str], ...] = ()
    text_numbers: frozenset[str] = frozenset()
    row_dependents: tuple[str, ...] = ()
    order: tuple[str, ...] = ()
    notes: tuple[tuple[str, int], ...] = ()
    id: str = ""

    def columns(self) -> dict[str, Kind]:
        given = {k.lower(): v for k, v in self.kinds.items()}
        return {f.name: given.get(f.name.lower()) or replace(kind_of(f.dataType), nullable=f.nullable) for f in self.df.schema if not f.name.startswith("__")}


@dataclass(frozen=True)
class Link:
    left: str
    left_column: str
    right: str
    right_column: str
    approved: bool = True


@dataclass(frozen=True)
class Metric:
    name: str
    entity: str
    fn: str
    of: str
    where: dict | None = None


@dataclass(frozen=True)
class TimeDimension:
    name: str
    entity: str
    column: str
    grains: tuple[str, ...] = ("year", "quarter", "month", "week", "day")
    week_start: str | None = "monday"


@dataclass(frozen=True)
class TemplateColumn:
    name: str
    base: str = "text"
    allowed: tuple[str, ...] | None = None
    formula: bool = False


@dataclass(frozen=True)
class Environment:
    entities: dict[str, Entity]
    links: tuple[Link, ...] = ()
    metrics: tuple[Metric, ...] = ()
    time_dimensions: tuple[TimeDimension, ...] = ()
    templates: dict[str, tuple[TemplateColumn, ...]] = field(default_factory=dict)
    sheets: tuple[str, ...] = ()
    untraceable: bool = False  # something refers to these tables in a way that can't be followed

    def entity(self, name: str, code: str = "E_UNKNOWN_SOURCE") -> Entity:
        for known, e in self.entities.items():
            if known.lower() == name.lower():
                return e
        raise PlanError(code, f"there is no table {name!r}", names=sorted(self.entities), wanted=name)


@dataclass(frozen=True)
class Frame:
    """A lazy table between two steps: visible columns with their kinds, and hidden ones for order and errors."""

    df: DataFrame
    kinds: dict[str, Kind]
    errors: frozenset[str] = frozenset()  # columns with an error column beside them
    origin: dict[str, tuple[str, str]] = field(default_factory=dict)  # column: (entity, its column)
    gone: frozenset[str] = frozenset()
    measures: frozenset[str] = frozenset()  # of an aggregate just before
    sorted: bool = False
    seen: tuple = ()  # (code, Observation) of what running the plan meets

    @staticmethod
    def of(entity: Entity) -> Frame:
        """All columns.  An order of the entity's own is there from the start; any other is added by ``in_order`` where a
        step first needs it, above the filters, which so reach the scan."""
        kinds = entity.columns()
        shadows = [ERROR + c for c in kinds if ERROR + c in entity.df.columns]
        df = entity.df.select(*[f"`{c}`" for c in kinds], *[f"`{s}`" for s in shadows])
        if entity.order:
            df = df.withColumn(RID, F.struct(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(entity.order)]))
        return Frame(df, kinds, frozenset(c.removeprefix(ERROR) for c in shadows), {c: (entity.name, c) for c in kinds})

    def in_order(self) -> Frame:
        return self if RID in self.df.columns else replace(self, df=self.df.withColumn(RID, F.monotonically_increasing_id()))

    def name(self, column: str, code: str = "E_UNKNOWN_COLUMN") -> str:
        """The column's own spelling."""
        for c in self.kinds:
            if c.lower() == column.lower():
                return c
        if column.lower() in self.gone and code == "E_UNKNOWN_COLUMN":
            raise PlanError("E_COLUMN_NOT_IN_OUTPUT", f"column {column!r} is gone after an earlier step", names=list(self.kinds), wanted=column)
        raise PlanError(code, f"there is no column {column!r}", names=list(self.kinds), wanted=column)

    def error(self, column: str):
        return F.col(f"`{ERROR}{column}`") if column in self.errors else None

    def hidden(self) -> list[str]:
        return [c for c in self.df.columns if c.startswith("__")]

    def visible(self) -> DataFrame:
        return self.df.select(*[f"`{c}`" for c in self.kinds])
