"""Mixing sources to target weights by entropy balancing.

Each source has a target number of words.  Among all document rates in [0, cap]
whose expected words meet the target, the one closest to 1 in relative entropy is
exponentially tilted: rate = min(cap, exp(lambda * size / scale)).  The dual in
lambda is convex and is solved for all sources at once by guarded Newton steps;
a step is one aggregation over the histogram of sizes, and the driver learns only
whether all sources are near enough.

Rates become whole copies by systematic rounding: with the documents of a source
in order of size, a further copy is due each time the summed fractions pass a
half, so the words taken stray from the expectation by about one document.  The
running sums go over hashed blocks of a source (their totals first, then inside
of each), so a source with a third of all rows is divided among many tasks.  The
rest to the target is made up with copies of small documents.

All sums that decide are of integers or decimals, so reruns agree.

Defined results: null texts have size 0 and are never taken; a null source is a
source, the last in order; repeated rows are documents of their own.  An empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, count_words, cut

UNIT = 1_000_000  # fractions of a copy are counted in this unit
ROWS_A_BLOCK = 8  # documents are dealt into sqrt(documents) / this many blocks a source
STEPS_A_JOB = 4  # Newton steps between two looks at whether all sources are near enough
REPAIRS = 3  # rounds that make up for what rounding left; each leaves less than one small document


def fill_targets(sources: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """``sources`` (key, source_size) with target: ``share`` of all words by weight, none above ``cap`` times its size.

    The weights go round in the order of keys.  Sources are filled in order of
    the level at which they reach their limit; the final level is that of the
    first one that doesn't.
    """
    ranked = sources.withColumn("_i", F.row_number().over(Window.orderBy("key")) - 1)
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("_i") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("_w", weight).withColumn("_most", F.col("source_size") * F.lit(float(cap)))
    by_level = Window.orderBy(F.col("_most") / F.col("_w"), "key")
    upto, onwards = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share)) - F.coalesce(F.sum("_most").over(upto), F.lit(0.0))) / F.sum("_w").over(onwards)
    leveled = ranked.withColumn("_level", level).withColumn("_free", F.col("_most") > F.col("_level") * F.col("_w"))
    final = F.min(F.when(F.col("_free"), F.struct(F.col("_most") / F.col("_w"), "_level"))).over(Window.partitionBy())
    target = F.least(F.col("_most"), F.coalesce(final["_level"] * F.col("_w"), F.col("_most")))
    return leveled.withColumn("target", target).drop("_i", "_w", "_most", "_level", "_free")


def solve_tilts(sizes: DataFrame, sources: DataFrame, cap: float, tolerance: float = 1e-5, max_steps: int = 60) -> DataFrame:
    """``sources`` with scale and lambda, such that the rates meet the targets.

    ``sizes``: key, size, n, the histogram of document sizes.
    """
    scale = sizes.groupBy("key").agg((F.sum((F.col("n") * F.col("size") * F.col("size")).cast("decimal(38,0)")) / F.sum(F.col("n") * F.col("size"))).cast("double").alias("scale"))
    full = F.col("target") >= F.col("source_size") * F.lit(cap * (1 - 1e-12))
    start = sources.join(scale, "key", "left").withColumns({"scale": F.coalesce("scale", F.lit(1.0)), "lambda": F.when(full, F.lit(float("inf"))).otherwise(0.0)})
    scratch = Scratch(sizes.sparkSession, "tilts")
    start = scratch.cut(start, "start")
    state = start.where(F.col("lambda") == 0).withColumns({"low": F.lit(float("-inf")), "high": F.lit(float("inf"))})
    for _ in range(max_steps // STEPS_A_JOB):
        for _ in range(STEPS_A_JOB):
            state = _newton_step(state, sizes, cap, tolerance)
        state = scratch.cut(state, "state")
        if state.where("not done").isEmpty():
            break
        state = state.drop("done")
    return start.where(F.col("lambda") > 0).unionByName(state.select(*start.columns))


def _newton_step(state: DataFrame, sizes: DataFrame, cap: float, tolerance: float) -> DataFrame:
    """One step for all sources at once: a join with the histogram, two sums and the next lambda inside of its bracket."""
    rate = tilted_rate(cap)
    exact = F.round(rate, 9).cast("decimal(12,9)")
    words = F.sum((F.col("n") * F.col("size")).cast("decimal(25,0)") * exact)
    slope = F.sum((F.col("n") * F.col("size") * F.col("size")).cast("decimal(25,0)") * F.when(rate < cap, exact).otherwise(F.lit(0).cast("decimal(12,9)")))
    own = [c for c in state.columns if c != "done"]
    x = sizes.join(state.select(*own), "key").groupBy(*own).agg(words.cast("double").alias("f"), slope.cast("double").alias("g"))
    miss = F.col("target") - F.col("f")
    done = F.abs(miss) <= tolerance * F.greatest(F.col("target"), F.lit(1.0))
    x = x.withColumns({"low": F.when(miss > 0, F.col("lambda")).otherwise(F.col("low")), "high": F.when(miss < 0, F.col("lambda")).otherwise(F.col("high"))})
    newton = F.col("lambda") + F.when(F.col("g") > 0, miss / (F.col("g") / F.col("scale"))).otherwise(F.signum(miss) * 8.0)
    newton = F.greatest(F.least(newton, F.col("lambda") + 8.0), F.col("lambda") - 8.0)
    inside = (newton > F.col("low")) & (newton < F.col("high"))
    step = F.when(inside, newton).otherwise((F.col("low") + F.col("high")) / 2)
    return x.withColumns({"done": done, "lambda": F.when(done, F.col("lambda")).otherwise(step)}).select(*own, "done")


def tilted_rate(cap: float):
    """Rate of a document by its size, and the lambda and scale of its source."""
    return F.least(F.lit(float(cap)), F.exp(F.col("lambda") * F.col("size") / F.col("scale")))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: int = 2
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, source, rate, copies."""
    key = F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("t"))  # the null source sorts last
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source).alias("source"), key.alias("key"), count_words(F.col(text).cast("string")).alias("size"))
    rows = cut(rows.withColumn("h", F.xxhash64("doc_id")), "sized")
    totals = rows.groupBy("key").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    sources = cut(fill_targets(totals, weights, share, cap), "targets")
    sizes = cut(rows.where("size > 0").groupBy("key", "size").agg(F.count("*").alias("n")), "histogram")
    tilts = solve_tilts(sizes, sources, float(cap))

    blocks = max(1, round((sources.agg(F.coalesce(F.sum("docs"), F.lit(0))).first()[0]) ** 0.5 / ROWS_A_BLOCK))
    rated = rows.join(tilts, "key").withColumn("rate", F.when(F.col("size") > 0, tilted_rate(cap)).otherwise(F.lit(0.0)))
    rated = rated.withColumn("whole", F.floor("rate").cast("long")).withColumn("part", F.round((F.col("rate") - F.col("whole")) * UNIT).cast("long"))
    rated = cut(rated.withColumn("block", F.pmod("h", F.lit(blocks)).cast("int")), "rated")

    before = _sum_before(rated, "part")
    within = Window.partitionBy("key", "block").orderBy(F.desc("size"), "h", "doc_id")
    passed = F.col("before") + F.sum("part").over(within.rowsBetween(Window.unboundedPreceding, 0))
    due = lambda c: F.floor((c + UNIT // 2) / UNIT)
    copied = rated.join(before, ["key", "block"]).withColumn("passed", passed)
    copied = cut(copied.withColumn("copies", (F.col("whole") + due(F.col("passed")) - due(F.col("passed") - F.col("part"))).cast("long")).drop("before", "passed"), "copied")

    for _ in range(REPAIRS):
        copied = cut(_settle(copied, cap), "settled")
    return copied.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "rate", "copies")


def _settle(copied: DataFrame, cap: int) -> DataFrame:
    """``copied`` with a copy more or less of the first documents that fit into what a source lacks or has too much."""
    # Documents meet what is per source by (source, block): a join by source alone would deal a hot source to one task.
    sums = cut(copied.groupBy("key", "block").agg(F.first("target").alias("target"), F.sum(F.col("copies") * F.col("size")).alias("taken")), "taken")
    lacks = sums.groupBy("key").agg((F.round(F.first("target")).cast("long") - F.sum("taken")).alias("rest"))
    rest = cut(sums.select("key", "block").join(lacks, "key"), "rest")
    fit = F.when(F.col("rest") > 0, F.col("copies") < cap).otherwise(F.col("copies") > 0)
    able = copied.join(rest, ["key", "block"]).withColumn("able", F.when(fit & (F.col("size") <= F.abs("rest")), F.col("size")).otherwise(0).cast("long"))
    run = F.col("before") + F.sum("able").over(Window.partitionBy("key", "block").orderBy("size", "h", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    settled = able.join(_sum_before(able, "able"), ["key", "block"]).withColumn("run", run)
    change = F.when((F.col("able") > 0) & (F.col("run") <= F.abs("rest")), F.signum("rest")).otherwise(0).cast("long")
    return settled.withColumn("copies", F.col("copies") + change).select(*copied.columns)


def _sum_before(rows: DataFrame, value: str) -> DataFrame:
    """(key, block, before): the sum of ``value`` over the earlier blocks of a source.

    Written at once: Spark would else deal the documents by source alone, to suit this window.
    """
    sums = rows.groupBy("key", "block").agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return cut(sums.select("key", "block", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("before")), "before")
