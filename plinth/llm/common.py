"""Small helpers that several operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()
#: A word is a run of characters that are not ASCII white space.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z; every other character stays as it is."""
    return F.translate(c, ASCII_UPPER, ASCII_LOWER)


def count_words(text: Column) -> Column:
    """Number of runs without ASCII white space; null has none."""
    parts = F.array_remove(F.split(text, SPACE_CLASS + "+"), "")
    return F.when(text.isNull(), F.lit(0)).otherwise(F.size(parts)).cast("long")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors can see.

    The cluster names it in ``spark.checkpoint.dir``.  Where that is unset, a
    local session gets a temporary folder and a cluster its warehouse.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        named = tempfile.mkdtemp(prefix="plinth-")
    else:
        named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/plinth-work"
    spark.conf.set("spark.checkpoint.dir", named)
    return named


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Later steps read the files, so that a lost executor costs a re-read and not
    a recomputation, and iterative plans stay short.
    """
    return _written(df, f"{shared_folder(df.sparkSession)}/plinth/{name}-{uuid.uuid4().hex}")


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Written tables of one run by name, as in a loop: a table takes the place of the earlier one of its name.

    The earlier files go once the later ones are written, so that a loop of any
    number of rounds holds one version of each table.  Nothing may still read an
    earlier version by then.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.root, self.paths, self.spark = f"{shared_folder(spark)}/plinth/{name}-{uuid.uuid4().hex}", {}, spark

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        out = _written(df, path)
        self.drop(name)
        self.paths[name] = path
        return out

    def drop(self, *names: str) -> None:
        for name in names:
            old = self.paths.pop(name, None)
            if old is not None:
                target = self.spark._jvm.org.apache.hadoop.fs.Path(old)
                target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def class_shares(counts: dict[int, int], most: int) -> dict[int, int]:
    """How many rows of class 0 and 1 to learn from, ``most`` in all: half each, and what one class leaves goes to the other."""
    n0, n1 = counts.get(0, 0), counts.get(1, 0)
    of_1 = min(n1, max(most // 2, most - n0))
    return {0: min(n0, most - of_1), 1: of_1}


def spread_join(rows: DataFrame, few: DataFrame, key: str, by: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``few`` (one row a key) in which no key's rows meet in one task.

    Rows are dealt by key and a hash of ``by``; first the distinct pairs of both get what
    the key has, at most as many for a key as there are shuffle partitions.  Written in
    between: Spark would else deal the rows by key alone, to suit the first join.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("__part", F.pmod(F.xxhash64(by), F.lit(parts)).cast("int"))
    near = cut(dealt.select(key, "__part").distinct().join(few, key, how), "spread")
    return dealt.join(near, [key, "__part"]).drop("__part")


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b); root is the least node reachable.

    Each round hooks a node to its least neighbour, halves the pointer paths
    until they are flat, and contracts the graph; the number of nodes left falls
    by a factor each time.  All of it is joins and grouped minima; the driver
    only learns whether edges are left.
    """
    scratch = Scratch(edges.sparkSession, name)
    edges = scratch.cut(edges.select("a", "b").where("a <> b").distinct(), "edges")
    if edges.isEmpty():
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    labels = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("p"))
        parent = scratch.cut(parent.select("node", F.least("node", "p").alias("p"), F.lit(True).alias("moved")), "parent")
        while True:
            up = parent.select(F.col("node").alias("p"), F.col("p").alias("pp"))
            parent = scratch.cut(parent.join(up, "p").select("node", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")), "parent")
            if parent.where("moved").isEmpty():
                break
        step = parent.select(F.col("node").alias("root"), "p")
        if labels is None:
            labels = parent.select("node", F.col("p").alias("root"))
        else:
            labels = labels.join(step, "root", "left").select("node", F.coalesce("p", "root").alias("root"))
        labels = scratch.cut(labels, "labels")
        pa = parent.select(F.col("node").alias("a"), F.col("p").alias("ra"))
        pb = parent.select(F.col("node").alias("b"), F.col("p").alias("rb"))
        met = edges.join(pa, "a").join(pb, "b").where("ra <> rb")
        edges = scratch.cut(met.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        if edges.isEmpty():
            scratch.drop("edges", "parent")
            return labels
