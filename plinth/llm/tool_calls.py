"""Tool-call linking for chat data.

Calls and results meet in a hash join on (conversation, call id).  Arguments are
validated against the schema of the tool that is called and written as canonical
JSON (sorted keys, no spaces, minimal escapes).

``position`` is the rank of a call in a topological order of its conversation: a
call's layer is one more than the highest layer of the calls that it depends on,
and calls are ordered by layer, then turn, then id.  Layers are found in blocks of
about ``BLOCK`` turns (and calls), each solved in one task; a further round is
needed only where a dependency leads out of a block, so ordinary conversations take
one round and very long ones as many as a chain crosses blocks.

Inputs: ``calls`` (conv_id, call_id, turn, name, arguments: JSON text, after:
array of call ids or null) and ``results`` (conv_id, call_id, turn, content).  Only
these columns are read, so further ones never clash.

Defined results: rows with a null conv_id or call_id link with nothing and keep
their status (unanswered, orphan) without a position; of calls with one id the
first by turn, then by name and arguments is linked and the others are duplicates,
which have no position; so with results, by turn and content.  Dependencies on
unknown calls count as met and are named in ``problems``, null ones are ignored;
calls in or behind a cycle have no position.  Arguments with numbers beyond doubles
or nested too deep are no JSON; half surrogate pairs are written as escapes; of
equal keys of an object the last counts.  Empty tables give empty results.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.canonical import canonical_json, text_text
from .common import Scratch, cut

BLOCK = 1024
IN_CYCLE = "in or behind a cycle of dependencies"
_KINDS = {"string": str, "boolean": bool, "object": dict, "array": list, "null": type(None)}


def violations(value: Any, schema: dict, at: str = "$") -> list[str]:
    """What of a JSON-schema subset (type, enum, bounds, properties, required, items) a value breaks."""
    kinds = schema.get("type")
    if kinds is not None:
        kinds = kinds if isinstance(kinds, list) else [kinds]
        number = isinstance(value, int | float) and not isinstance(value, bool)
        fits = {k: number and (k == "number" or value == int(value)) if k in ("number", "integer") else isinstance(value, _KINDS[k]) for k in kinds}
        if not any(fits.values()):
            return [f"{at}: not of type {' or '.join(kinds)}"]
    out = []
    if "enum" in schema and canonical_json(value, True) not in {canonical_json(x, True) for x in schema["enum"]}:  # true is not 1
        out.append(f"{at}: not one of the allowed values")
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0) or len(value) > schema.get("maxLength", math.inf):
            out.append(f"{at}: length {len(value)} is out of bounds")
    elif isinstance(value, int | float) and not isinstance(value, bool):
        if value < schema.get("minimum", -math.inf) or value > schema.get("maximum", math.inf):
            out.append(f"{at}: {value} is out of bounds")
    elif isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        if schema.get("additionalProperties", True) is False:
            out += [f"{at}.{k}: unknown" for k in sorted(value) if k not in known]
        for k in sorted(value.keys() & known.keys()):
            out += violations(value[k], known[k], f"{at}.{k}")
    elif isinstance(value, list) and "items" in schema:
        for i, v in enumerate(value):
            out += violations(v, schema["items"], f"{at}[{i}]")
    return out


def _no_number(name: str):
    raise ValueError(f"{name} is no JSON number")


def _finite(digits: str) -> float:
    value = float(digits)
    return value if math.isfinite(value) else _no_number(digits)


def _read_arguments(name: str | None, text: str | None, schemas: dict[str, dict]) -> tuple[str | None, list[str]]:
    try:
        value = json.loads(text or "", parse_constant=_no_number, parse_float=_finite)
        wrong = violations(value, schemas[name]) if name in schemas else ["unknown tool"]
        return canonical_json(value, exact_integers=True), [w.encode("utf-8", "backslashreplace").decode() for w in wrong]
    except (ValueError, RecursionError):
        return None, ["arguments are not JSON"]


def _numbered(rows: DataFrame, by: list[str], name: str, sign: int) -> DataFrame:
    """``rows`` with ``nth``: 0 for the first row of a call id by ``by``, else a number of the row's own with ``sign``.

    The first rows come from a grouped minimum, so an id with any number of rows is no hot key, here or in the join.
    """
    kept = cut(rows.withColumn("_row", F.monotonically_increasing_id() + 1), name)  # written, so the numbers stay
    named = kept.where("conv_id is not null and call_id is not null")
    first = named.groupBy("conv_id", "call_id").agg(F.min(F.struct(*by, "_row")).alias("_f")).select(F.col("_f._row").alias("_row"), F.lit(0).cast("long").alias("nth"))
    return kept.join(first, "_row", "left").withColumn("nth", F.coalesce("nth", F.col("_row") * sign)).drop("_row")


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """conv_id, call_id, turn, name, status, position, problems, record (canonical JSON) of each call and orphan result.

    status: linked, early (the result precedes its call), unanswered, orphan or duplicate.
    """
    key = ["conv_id", "call_id", "nth"]
    c = _numbered(calls.select("conv_id", "call_id", "turn", "name", "arguments", "after"), ["turn", "name", "arguments"], "calls", -1)
    c = cut(c, "numbered")
    r = _numbered(results.select("conv_id", "call_id", F.col("turn").alias("r_turn"), "content"), ["r_turn", "content"], "results", 1)
    c = c.drop("after").join(_positions(c.where("nth = 0").select("conv_id", "call_id", "turn", "after")), key, "left")
    both = c.withColumn("is_call", F.lit(True)).join(r.withColumn("is_result", F.lit(True)), key, "full")
    repeated = (F.col("nth") != 0) & F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    status = (
        F.when(repeated, "duplicate").when(F.col("is_call").isNull(), "orphan").when(F.col("is_result").isNull(), "unanswered")
        .when(F.col("r_turn") < F.col("turn"), "early").otherwise("linked")
    )
    flat = both.select(
        "conv_id", "call_id", F.coalesce("turn", F.when(F.col("is_call").isNull(), F.col("r_turn"))).alias("turn"), "name", "arguments", "position", "notes", status.alias("status"), "content",
        F.coalesce("is_call", F.lit(False)).alias("is_call"),
    )

    @F.pandas_udf("problems array<string>, record string")
    def write(conv: pd.Series, call: pd.Series, name: pd.Series, arguments: pd.Series, notes: pd.Series, content: pd.Series, is_call: pd.Series) -> pd.DataFrame:
        out = []
        for v, i, n, a, more, text, own in zip(conv, call, name, arguments, notes, content, is_call, strict=True):
            canonical, problems = _read_arguments(n, a, schemas) if own else (None, [])
            problems = [*problems, *(more if more is not None else [])]
            fields = {"conv_id": v, "id": i, "name": n, "result": text}
            body = [f'"{k}":{"null" if x is None else text_text(str(x))}' for k, x in fields.items()]
            out.append((problems, "{" + ",".join([f'"arguments":{canonical if canonical is not None else "null"}', *body]) + "}"))
        return pd.DataFrame(out, columns=["problems", "record"])

    text = lambda name: F.col(name).cast("string")
    made = flat.withColumn("_made", write(text("conv_id"), text("call_id"), text("name"), text("arguments"), "notes", text("content"), "is_call"))
    return made.select("conv_id", "call_id", "turn", "name", "status", "position", F.col("_made.problems").alias("problems"), F.col("_made.record").alias("record"))


def _turn_block(turn: Column) -> Column:
    return F.coalesce(F.floor(turn / F.lit(BLOCK)), F.lit(-(2**62))).cast("long")


def _positions(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, nth = 0, position, notes) of calls with ids that don't repeat."""
    key = ["conv_id", "call_id"]
    scratch = Scratch(calls.sparkSession, "order")
    block = calls.select(*key, _turn_block(F.col("turn")).alias("tb"))
    parts = block.groupBy("conv_id", "tb").agg(F.ceil(F.count(F.lit(1)) / (4 * BLOCK)).alias("parts"))
    block = block.join(parts, ["conv_id", "tb"]).select(*key, "tb", F.pmod(F.xxhash64("call_id"), "parts").alias("part"))
    edges = calls.select(*key, F.explode(F.array_distinct("after")).alias("dep")).where("dep is not null")
    known = block.select("conv_id", F.col("call_id").alias("dep"), F.struct("tb", "part").alias("dep_at"))
    edges = scratch.cut(edges.join(known, ["conv_id", "dep"], "left").join(block, key), "edges")
    unknown = edges.where("dep_at is null").groupBy(*key).agg(F.sort_array(F.collect_set(F.concat(F.lit("depends on unknown call "), F.col("dep").cast("string")))).alias("notes"))
    edges = edges.where("dep_at is not null")
    waiting = edges.select(*key).distinct()
    layers = calls.select(*key).join(waiting, key, "left_anti").withColumn("layer", F.lit(0).cast("long"))
    free = layers.select("conv_id", F.col("call_id").alias("dep"), F.col("layer").alias("known"))
    todo = edges.join(free, ["conv_id", "dep"], "left").select(*key, "dep", "tb", "part", (F.col("dep_at") == F.struct("tb", "part")).alias("here"), "known")
    todo, rounds = scratch.cut(todo, "todo"), 0
    while not todo.isEmpty():
        solved = scratch.cut(_solve(todo), f"solved{rounds}")
        found = solved.where("layer is not null")
        if found.isEmpty():
            break
        layers = layers.unionByName(found)
        fresh = found.select("conv_id", F.col("call_id").alias("dep"), F.col("layer").alias("fresh"))
        left = todo.join(found.select(*key), key, "left_anti").join(fresh, ["conv_id", "dep"], "left")
        todo = scratch.cut(left.withColumn("known", F.coalesce("known", "fresh")).select(*todo.columns), "todo")
        rounds += 1
    at = calls.select(*key, "turn", _turn_block(F.col("turn")).alias("tb")).join(layers, key, "left")
    group = ["conv_id", "layer", "tb"]
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("layer", "tb").rowsBetween(Window.unboundedPreceding, -1))
    sizes = at.where("layer is not null").groupBy(*group).agg(F.count(F.lit(1)).alias("n")).select(*group, F.coalesce(before, F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy(*group).orderBy("turn", "call_id"))
    ranked = at.withColumn("_nth", nth).join(cut(sizes, "layers"), group, "left")
    cycle = F.when(F.col("layer").isNull(), F.array(F.lit(IN_CYCLE))).otherwise(F.array())
    position = F.when(F.col("layer").isNotNull(), F.col("before") + F.col("_nth") - 1).cast("long")
    return ranked.join(unknown, key, "left").select(*key, F.lit(0).cast("long").alias("nth"), position.alias("position"), F.concat(F.coalesce("notes", F.array()), cycle).alias("notes"))


def _layers(rows: list[tuple]) -> Iterator[tuple]:
    """(call, layer or None) of the waiting calls of one block, from its (call, dependency, whether that is here, its layer)."""
    needs: dict = {}  # call: how many of its dependencies wait here, or outside (which can't be met in this round)
    lead: dict = {}  # dependency here: calls that wait for it
    layer: dict = {}
    for call, dep, here, known in rows:
        needs.setdefault(call, 0)
        layer.setdefault(call, 0)
        if known is not None:
            layer[call] = max(layer[call], known + 1)
            continue
        needs[call] += 1
        if here:
            lead.setdefault(dep, []).append(call)
    ready = [c for c, n in needs.items() if n == 0]
    for c in ready:  # grows while it is read
        for after in lead.get(c, ()):
            layer[after] = max(layer[after], layer[c] + 1)
            needs[after] -= 1
            if needs[after] == 0:
                ready.append(after)
    solved = set(ready)
    return ((c, layer[c] if c in solved else None) for c in needs)


def _solve(todo: DataFrame) -> DataFrame:
    """conv_id, call_id, layer (null where it isn't known yet) of the waiting calls, block by block."""
    block = ["conv_id", "tb", "part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, kinds = None, [], None

        def solved() -> pa.RecordBatch:
            found = [(now[0], *x) for x in _layers(rows)]
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], kind) for i, kind in enumerate(kinds)], ["conv_id", "call_id", "layer"])

        for batch in batches:
            kinds = [batch.schema.field(0).type, batch.schema.field(3).type, pa.int64()]
            for *key, call, dep, here, known in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if key != now:
                    if rows:
                        yield solved()
                    now, rows = key, []
                rows.append((call, dep, here, known))
        if rows:
            yield solved()

    kinds = {f.name: f.dataType.simpleString() for f in todo.schema}
    blocks = todo.select(*block, "call_id", "dep", "here", "known").repartition(*block).sortWithinPartitions(*block)
    return blocks.mapInArrow(run, f"conv_id {kinds['conv_id']}, call_id {kinds['call_id']}, layer long")
