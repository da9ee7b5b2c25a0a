"""A training corpus from ``documents``: quality, lines, near copies, benchmarks, mix.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and returns a DataFrame, which ``run`` writes as Parquet and reads again as the
next one's documents.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.llm import decontaminate, line_dedup, mixing, near_dup, quality
from plinth.llm.common import cut, table
from plinth.llm.queries import KEEP_SCORE, part_of_ids


#: Columns that line dedup adds; documents that have columns of these names keep their own.
_ADDED = ("n_lines", "n_removed")


def _recounted(docs: DataFrame, out: DataFrame) -> DataFrame:
    """``out`` with the columns of ``docs``; n_chars follows the text."""
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = quality.train(docs, table(spark, sf_dir, "labels").where(part_of_ids("doc_id", 5) != 0))
    return quality.score_quality(docs, model, score_col="__score").where(F.col("__score") >= KEEP_SCORE).drop("__score")


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows removed; a document of which nothing else is left goes."""
    own = {c: f"__own_{c}" for c in docs.columns if c.lower() in _ADDED}
    clean = line_dedup.dedup_lines(docs.withColumnsRenamed(own)).where("n_removed = 0 or length(trim(text)) > 0")
    return _recounted(docs, clean.drop(*_ADDED).withColumnsRenamed({new: c for c, new in own.items()}))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: shingles of five words, similarity 0.8 or more."""
    return near_dup.keep_first(docs, words_each=5, percent=80)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages cut out; documents that are half benchmark go."""
    return _recounted(docs, decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), 10, 0.5))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


STAGES = [
    ("quality classifier", good_quality),
    ("line dedup", without_repeated_lines),
    ("MinHash near-dedup", without_near_copies),
    ("benchmark decontamination", without_benchmarks),
    ("mixing sources to target weights", mixed),
]
#: The classifier is trained, which SQL can't express; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
