"""Language ID by bit-sliced Bloom filters over character n-grams.

All languages share one table of bit masks.  An n-gram of a language sets that
language's bit in the slots that its hashes name; the AND of the slots of an
n-gram gives all languages that contain it, in one look-up.  A text is decided by
the popcounts of its n-grams for each language, corrected for the expected false
positives of that language's slice.

Which n-grams a language contains is learned on Spark from about ``MAX_TRAIN``
documents a language (those of the least hashes): all that make up at least
``MIN_SHARE`` of its n-grams, whatever other languages contain them.  So the filter
holds, and the driver gets, at most 1 / MIN_SHARE of them a language.

Defined results: ``und`` with score 0 for a text that is null or has no letter; a
text without any known n-gram gets the most frequent language with score 0; ties
go to the language first by name.  Without labelled rows all texts are ``und``.
Repeated rows are judged alike.  Other columns pass through; existing columns
lang_pred and score are replaced.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAM = 4  # bytes
MAX_TRAIN, MIN_SHARE = 2000, 2e-5
MASK = 64  # languages in one mask word
SLOT_BITS, PIECE = 20, 1 << 21
_CODES = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)  # odd multipliers
_ALPHA = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def normal(text: str | None) -> bytes:
    """Lower-cased letters and other non-ASCII, single spaces between and two around."""
    return b"  " + b" ".join((text or "").lower().encode("utf-8", "replace").translate(_ALPHA).split()) + b"  "


def codes(data: bytes) -> np.ndarray:
    """The n-gram that starts at each byte, as a number."""
    a = np.frombuffer(data, np.uint8).astype(np.uint32)
    return a[:-3] | a[1:-2] << np.uint32(8) | a[2:-1] << np.uint32(16) | a[3:] << np.uint32(24)


def slots(grams: np.ndarray) -> list[np.ndarray]:
    mixed = grams ^ (grams >> np.uint32(15))
    return [(mixed * np.uint32(c)) >> np.uint32(32 - SLOT_BITS) for c in _CODES]


@dataclass(frozen=True)
class LanguageFilter:
    """``masks``: one mask word a slot for each 64 languages."""

    languages: list[str]
    default: int
    masks: list[np.ndarray]
    wrong: np.ndarray  # false-positive rate by language

    def containing(self, grams: np.ndarray) -> list[np.ndarray]:
        """The languages that contain each n-gram, as bits."""
        s = slots(grams)
        return [m[s[0]] & m[s[1]] & m[s[2]] for m in self.masks]

    def counts(self, texts: list[bytes]) -> np.ndarray:
        """Corrected popcounts, texts by languages."""
        out, grams = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        pieces = [(i, t[at : at + PIECE + GRAM - 1]) for i, t in enumerate(texts) for at in range(0, max(1, len(t) - GRAM + 1), PIECE)]
        at = 0
        while at < len(pieces):
            end, size = at, 0
            while end < len(pieces) and (size == 0 or size + len(pieces[end][1]) <= PIECE):
                size += len(pieces[end][1])
                end += 1
            part = pieces[at:end]
            lengths = np.array([len(p) for _, p in part])
            stops = np.cumsum(lengths)
            found = self.containing(codes(b"".join(p for _, p in part)))
            first, last, own = stops - lengths, stops - (GRAM - 1), np.array([i for i, _ in part])
            np.add.at(grams, own, last - first)
            for c in range(len(self.languages)):
                mask = found[c // MASK]
                run = np.concatenate([[0], np.cumsum((mask >> mask.dtype.type(c % MASK)) & mask.dtype.type(1), dtype=np.int64)])
                np.add.at(out[:, c], own, run[last] - run[first])
            at = end
        return np.maximum(0.0, (out - grams[:, None] * self.wrong) / (1 - self.wrong))

    def decide(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        found = self.counts([normal(t) for t in texts])
        best, total = found.argmax(axis=1), found.sum(axis=1)
        top = found[np.arange(len(found)), best]
        best = np.where(total > 0, best, self.default)
        return [self.languages[b] for b in best], np.where(total > 0, top / np.maximum(total, 1e-9), 0.0)


def fill_filter(grams: dict[str, np.ndarray], default: str) -> LanguageFilter:
    """The filter of the n-grams of each language."""
    names = sorted(grams)
    masks = [np.zeros(1 << SLOT_BITS, np.uint8 if len(names) <= 8 else np.uint64) for _ in range(0, len(names), MASK)]
    wrong = np.zeros(len(names))
    for c, name in enumerate(names):
        mask = masks[c // MASK]
        bit = mask.dtype.type(1 << c % MASK)
        for s in slots(grams[name].astype(np.uint32)):
            mask[s] |= bit
        wrong[c] = (np.count_nonzero(mask & bit) / len(mask)) ** len(_CODES)
    return LanguageFilter(names, names.index(default), masks, wrong)


def train(docs: DataFrame, lang: str = "lang", text: str = "text", id_col: str = "doc_id", max_train: int = MAX_TRAIN) -> LanguageFilter | None:
    """The filter from rows with text and language; None without any."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("l"), F.col(text).cast("string").alias("t"), F.xxhash64(id_col, text).alias("h"))
    known = sorted((r["l"], r["n"]) for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect())  # one row a language
    if not known:
        return None
    pick = F.create_map(*[x for name, n in known for x in (F.lit(name), F.lit(min(1_000_000, -(-1_000_000 * max_train // n))))])
    sample = rows.where(F.pmod("h", F.lit(1_000_000)) < pick[F.col("l")])

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, list[bytes]] = {}
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(name, []).append(normal(t))
            for name, texts in by.items():
                g, n = np.unique(codes(b"".join(texts)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(g), pa.string()), pa.array(g.astype(np.int64)), pa.array(n.astype(np.int64))], ["l", "g", "n"])

    counted = sample.select("l", "t").mapInArrow(grams, "l string, g long, n long").groupBy("l", "g").agg(F.sum("n").alias("n")).persist()
    totals = {r["l"]: r["n"] for r in counted.groupBy("l").agg(F.sum("n").alias("n")).collect()}
    least = F.create_map(*[x for k, n in totals.items() for x in (F.lit(k), F.lit(MIN_SHARE * n))])[F.col("l")]
    chosen = counted.where(F.col("n") >= least).select("l", "g").toPandas()
    counted.unpersist()
    by = {name: chosen.loc[chosen["l"] == name, "g"].to_numpy() for name, _ in known}
    return fill_filter(by, max(known, key=lambda x: x[1])[0])


def identify(docs: DataFrame, model: LanguageFilter | None, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (0 to 1)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        names, scores = shared.value.decide(list(texts))
        return pd.DataFrame({"lang": names, "score": scores})

    body = F.col(text).cast("string")
    letters = F.coalesce(body.rlike(r"\p{L}"), F.lit(False))
    if model is None:
        return docs.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
    found = docs.withColumn("__found", predict.asNondeterministic()(F.coalesce(body, F.lit(""))))
    return found.withColumns({"lang_pred": F.when(letters, F.col("__found.lang")).otherwise("und"), "score": F.when(letters, F.col("__found.score")).otherwise(0.0)}).drop("__found")
