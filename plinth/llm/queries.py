"""The registered queries of the ten operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, lang_id, line_dedup, mixing, near_dup, quality, secrets, tool_calls, topk, url_filter
from .common import cut, table

URL_RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
KEEP_SCORE, PIECE_WORDS = 0.3, 20
#: The tools that the turns of ``conversations`` stand for: see ``calls_of``.
SCHEMAS = {
    "reply": {
        "type": "object", "required": ["prompt", "turn"], "additionalProperties": False,
        "properties": {"prompt": {"type": "string", "minLength": 1, "maxLength": 2000}, "turn": {"type": "integer", "minimum": 0}},
    },
    "configure": {
        "type": "object", "required": ["instructions"], "additionalProperties": False,
        "properties": {"instructions": {"type": "string", "minLength": 1}},
    },
}


def part_of_ids(id_col: str, parts: int):
    """crc32 of the id as text, modulo ``parts``."""
    return F.crc32(F.col(id_col).cast("string")) % parts


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(docs, labels.where(part_of_ids("doc_id", 5) != 0))
    scored = quality.score_quality(docs, model)
    return scored.select("doc_id", (part_of_ids("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= KEEP_SCORE).cast("int").alias("predicted"))


def op3_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), words_each=4, percent=80)


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topk.integer_vectors(table(spark, sf_dir, "embeddings"), "embedding", 64)
    found = topk.top_k(rows, rows.where(F.col("vec_id") % 20 == 0), 20)
    return found.select("query_id", "rank", "vec_id", F.col("score").cast("long").alias("score"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def calls_of(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns as tool calls and results, as ``conversations`` has none of its own.

    A user turn calls ``reply`` with its text and number, a system turn calls
    ``configure``; the id of a call is its turn.  An assistant turn is the result
    of the call in the turn before.  A call depends on the last call at most two
    turns before it, but one of a turn divisible by six on the next call at most
    two turns after it, and those one or two turns later on none.
    """
    asks = conversations.where(F.col("role").isin("user", "system"))
    arguments = F.when(
        F.col("role") == "user", F.to_json(F.struct(F.col("text").alias("prompt"), "turn"))
    ).otherwise(F.to_json(F.struct(F.col("text").alias("instructions"))))
    calls = asks.select("conv_id", F.col("turn").cast("string").alias("call_id"), "turn", F.when(F.col("role") == "user", "reply").otherwise("configure").alias("name"), arguments.alias("arguments"))
    there = calls.select("conv_id", F.col("turn").alias("_dep")).distinct()
    ahead, place = F.col("turn") % 6 == 0, F.col("turn") % 6
    near = calls.select("conv_id", "turn").distinct().where(~place.isin(1, 2)).withColumn("_sign", F.when(ahead, 1).otherwise(-1))
    near = near.withColumn("_dep", F.explode(F.array(F.col("turn") + F.col("_sign"), F.col("turn") + 2 * F.col("_sign")))).join(there, ["conv_id", "_dep"])
    nearest = near.groupBy("conv_id", "turn").agg(F.array(F.min_by("_dep", F.abs(F.col("_dep") - F.col("turn"))).cast("string")).alias("after"))
    results = conversations.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).cast("string").alias("call_id"), "turn", F.col("text").alias("content"))
    return calls.join(nearest, ["conv_id", "turn"], "left"), results


def op6_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = calls_of(table(spark, sf_dir, "conversations"))
    linked = tool_calls.link_tool_calls(calls, results, SCHEMAS)
    return linked.select("conv_id", "call_id", "turn", "name", "status", "position", F.size("problems").cast("long").alias("n_problems"), F.sha2("record", 256).alias("record_sha256"))


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return clean.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


def op8_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Like op8_line_dedup, and passages inside lines: three sentences of ``PIECE_WORDS`` words or more."""
    clean = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), piece_words=PIECE_WORDS)
    return clean.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = lang_id.train(docs.where(part_of_ids("doc_id", 4) != 2))
    found = lang_id.identify(docs, model)
    return found.select("doc_id", (part_of_ids("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned from labels by published shapes in documents whose crc32(doc_id as text) mod 5 is not 0; the others are held out."""
    docs = table(spark, sf_dir, "documents")
    found = cut(secrets.shape_labels(secrets.candidates(docs, secrets.dictionary(docs))), "findings")
    scored = secrets.remove_false_positives(found, found.where(part_of_ids("doc_id", 5) != 0))
    held_out = part_of_ids("doc_id", 5) == 0
    return scored.select("doc_id", "begin", "length", "sha256", "probability", (F.col("probability") >= 0.5).alias("is_secret"), "label", held_out.alias("held_out"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_url_filter, op2_quality, op3_near_dup, op4_top_k, op5_decontaminate, op6_tool_calls, op7_mix, op8_line_dedup, op8_passage_dedup, op9_language, op10_secrets)
}
