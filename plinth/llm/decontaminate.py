"""Benchmark decontamination: a generalised suffix automaton over item words.

The normalised words of all items go into automata of about ``MAX_CHUNK_WORDS`` words
each, which Spark tasks build; an item longer than ``SEGMENT_WORDS`` is cut into
segments that overlap by a window less a word, so that every window lies in one of
them and no automaton grows beyond its bound.  Automata are broadcast in rounds of
``CHUNKS_AT_ONCE``, which one pass over the texts applies together; with more rounds
the table is written in between.  So driver and workers hold one round's automata.

The words of a text are streamed through an automaton; after each word it
knows the longest suffix that occurs in some item.  Where that reaches
the window length, the last ``window`` words are a window of an item; an item of
fewer words is one window as a whole.  Words inside such windows are hit.

``scan`` adds what was found, ``decontaminate`` removes the hit spans and drops
texts of which too much is hit.

Normal form: A-Z lower-cased, words are runs of characters other than ASCII
non-alphanumerics.  Defined results: a null or blank text has no words and no
hits; null items have none; an item without an id hits words but can't be named;
repeated items all count as occurring; without items nothing is hit.  An empty table
gives an empty result.  Other columns pass through; ``scan`` replaces existing columns
n_words, n_hit, items and ranges, ``decontaminate`` none.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

MAX_CHUNK_WORDS, SEGMENT_WORDS, CHUNKS_AT_ONCE = 200_000, 20_000, 4
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_KEEP = b"0123456789abcdefghijklmnopqrstuvwxyz"
_NORMAL = bytes(c if c >= 128 or c in _KEEP else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_LOWER = {c: c + 32 for c in range(65, 91)}


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_NORMAL).split() if text else []


class SuffixAutomaton:
    """Of the word sequences of items; states know the items that their windows are from."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.window, self.words = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        coded = [(item, [self.words.setdefault(w, len(self.words)) for w in ws]) for item, ws in items if ws]
        for _, ws in coded:
            last = 0
            for w in ws:
                last = self._extend(last, w)
        self.items: list[set[str]] = [set() for _ in self.next]
        self.whole: dict[int, set[str]] = {}
        for item, ws in coded:
            v = 0
            for w in ws:
                v = u = self.next[v][w]
                while item is not None and self.size[u] >= window and item not in self.items[u]:
                    self.items[u].add(item)
                    u = self.link[u]
            if len(ws) < window:
                self.whole.setdefault(v, set()).update([] if item is None else [item])
        # The nearest state on the suffix path, itself included, that is a whole short item.
        self.short = [-1] * len(self.next)
        for v in sorted(range(len(self.next)), key=self.size.__getitem__):
            if v:
                self.short[v] = v if v in self.whole else self.short[self.link[v]]
        self.least = min([window, *(self.size[v] for v in self.whole)])
        # One table of all steps, by state and word, is a fraction of a table for each state.
        self.width = max(1, len(self.words))
        self.steps = {v * self.width + w: u for v, follow in enumerate(self.next) for w, u in follow.items()}
        del self.next

    def _extend(self, last: int, w: int) -> int:
        known = self.next[last].get(w)
        if known is not None:
            return known if self.size[known] == self.size[last] + 1 else self._split(last, w, known)
        state = self._state(self.size[last] + 1, {}, 0)
        while last >= 0 and w not in self.next[last]:
            self.next[last][w] = state
            last = self.link[last]
        if last >= 0:
            q = self.next[last][w]
            self.link[state] = q if self.size[q] == self.size[last] + 1 else self._split(last, w, q)
        return state

    def _split(self, p: int, w: int, q: int) -> int:
        """A copy of q for the shorter strings, those that p's path leads to."""
        copy = self._state(self.size[p] + 1, dict(self.next[q]), self.link[q])
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def _state(self, size: int, follow: dict[int, int], link: int) -> int:
        self.next.append(follow)
        self.size.append(size)
        self.link.append(link)
        return len(self.next) - 1

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """The hit word ranges, apart and in order, and the items whose windows occur."""
        steps, width, link, size, window, least = self.steps.get, self.width, self.link, self.size, self.window, self.least
        found: list[tuple[int, int]] = []
        items: set[str] = set()
        v = length = 0
        for i, w in enumerate(map(self.words.get, words)):
            if w is None:
                v = length = 0
                continue
            to = steps(v * width + w)
            while to is None and v:
                v = link[v]
                length = size[v]
                to = steps(v * width + w)
            if to is None:
                v = length = 0
                continue
            v, length = to, length + 1
            if length < least:
                continue
            if length >= window:
                u = v
                while size[link[u]] >= window:
                    u = link[u]
                items |= self.items[u]
                found.append((i + 1 - window, i + 1))
            s = self.short[v]
            while s > 0:
                if size[s] <= length:
                    items |= self.whole[s]
                    found.append((i + 1 - size[s], i + 1))
                s = self.short[link[s]]
        merged: list[tuple[int, int]] = []
        for b, e in sorted(found):
            if merged and b <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(merged[-1][1], e))
            else:
                merged.append((b, e))
        return merged, items


def _segments(items: DataFrame, item_id: str, text: str, window: int, most: int) -> DataFrame:
    """(id, text, n): the normalised words of all items, long ones in overlapping segments of ``most`` words."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, sizes = [], [], []
            for own, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ws = words_of(t)
                for at in range(0, max(1, len(ws) - window + 1), most) if ws else ():
                    part = ws[at : at + most + window - 1]
                    ids.append(own)
                    texts.append(b" ".join(part).decode("utf-8", "surrogatepass"))
                    sizes.append(len(part))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(texts, pa.string()), pa.array(sizes, pa.int64())], ["id", "text", "n"])

    named = items.where(F.col(text).isNotNull()).select(F.col(item_id).cast("string").alias("id"), F.col(text).cast("string").alias("text")).distinct()
    return named.mapInArrow(split, "id string, text string, n long")


def _automata(items: DataFrame, item_id: str, text: str, window: int, max_words: int) -> tuple[DataFrame, int]:
    """(chunk, body): a pickled automaton for each chunk of the segments, built where Spark puts them; and how many chunks there are."""
    parts = cut(_segments(items, item_id, text, window, min(SEGMENT_WORDS, max(1, max_words // 4))), "items")
    chunks = max(1, -(-(parts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) // max_words))

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["id", "text"])
        automaton = SuffixAutomaton([(None if pd.isna(i) else i, words_of(t)) for i, t in zip(rows["id"], rows["text"], strict=True)], window)
        return pd.DataFrame({"chunk": [int(rows["chunk"].iloc[0])], "body": [pickle.dumps(automaton, pickle.HIGHEST_PROTOCOL)]})

    dealt = parts.withColumn("chunk", F.pmod(F.xxhash64("id", "text"), F.lit(chunks)).cast("int"))
    return cut(dealt.groupBy("chunk").applyInPandas(build, "chunk int, body binary"), "automata"), chunks


def _covered(ranges: Column) -> Column:
    """Number of words inside of ranges that may overlap."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda a, r: F.struct(F.greatest(a["end"], r["end"]).alias("end"), (a["n"] + F.greatest(F.lit(0), r["end"] - F.greatest(a["end"], r["begin"]))).alias("n"))
    return F.aggregate(F.array_sort(ranges), start, step, lambda a: a["n"])


_FOUND = "n long, ranges array<struct<begin:int,end:int>>, items array<string>"


def _scanner(bodies: list):
    """A UDF that streams texts through broadcast automata."""
    here: list[SuffixAutomaton] = []  # read once a worker

    @F.pandas_udf(_FOUND)
    def run(texts: pd.Series) -> pd.DataFrame:
        if len(here) < len(bodies):
            here.extend(pickle.loads(b.value) for b in bodies[len(here) :])
        rows = []
        for t in texts:
            words, ranges, items = words_of(t), [], set()
            for automaton in here:
                hit, known = automaton.scan(words)
                ranges += hit
                items |= known
            rows.append((len(words), [{"begin": b, "end": e} for b, e in sorted(ranges)], sorted(items)))
        return pd.DataFrame(rows, columns=["n", "ranges", "items"])

    return run.asNondeterministic()  # else a filter on its result runs it twice


def _found(docs: DataFrame, items: DataFrame, window: int, text: str, item_id: str, item_text: str, max_chunk_words: int) -> DataFrame:
    """``docs`` with __found: n (words), ranges (hit, may overlap) and items."""
    automata, chunks = _automata(items, item_id, item_text, window, max_chunk_words)
    context, out = docs.sparkSession.sparkContext, docs
    for first in range(0, chunks, CHUNKS_AT_ONCE):
        inside = (F.col("chunk") >= first) & (F.col("chunk") < first + CHUNKS_AT_ONCE)
        bodies = [context.broadcast(bytes(r["body"])) for r in automata.where(inside).orderBy("chunk").toLocalIterator()]
        scanned = _scanner(bodies)(F.col(f"`{text}`").cast("string"))
        if not first:
            out = out.withColumn("__found", scanned)
            continue
        out = cut(out, "scanned").withColumn("__more", scanned)
        both = lambda part: F.concat(f"__found.{part}", f"__more.{part}")
        out = out.withColumn("__found", F.struct(F.col("__found.n").alias("n"), F.array_sort(both("ranges")).alias("ranges"), F.array_sort(F.array_distinct(both("items"))).alias("items"))).drop("__more")
    return out


def scan(docs: DataFrame, items: DataFrame, window: int = 10, text: str = "text", item_id: str = "item_id", item_text: str = "text", max_chunk_words: int = MAX_CHUNK_WORDS) -> DataFrame:
    """``docs`` with n_words, n_hit, items (sorted ids as strings) and ranges (begin, end of hit words; they may overlap)."""
    out = _found(docs, items, window, text, item_id, item_text, max_chunk_words)
    return out.withColumns({"n_words": F.col("__found.n"), "n_hit": _covered(F.col("__found.ranges")), "items": F.col("__found.items"), "ranges": F.col("__found.ranges")}).drop("__found")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, max_coverage: float = 0.5, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` with the hit spans cut from their texts, without those of which more than ``max_coverage`` of the words are hit."""

    @F.pandas_udf("string")
    def remove(texts: pd.Series, ranges: pd.Series) -> pd.Series:
        out = []
        for t, spans in zip(texts, ranges, strict=True):
            if not len(spans):
                out.append(t)
                continue
            places = [m.span() for m in WORD.finditer(t.translate(_LOWER))]
            pieces, at = [], 0
            for s in sorted(spans, key=lambda s: s["begin"]):
                pieces.append(t[at : places[s["begin"]][0]])
                at = max(at, places[s["end"] - 1][1])
            out.append("".join([*pieces, t[at:]]))
        return pd.Series(out)

    found = _found(docs, items, window, text, item_id, item_text, MAX_CHUNK_WORDS)
    hit = _covered(F.col("__found.ranges"))
    found = found.withColumn("__hit", hit).where(F.col("__hit") <= F.lit(max_coverage) * F.col("__found.n"))
    some, body = F.col("__hit") > 0, F.col(f"`{text}`")
    clean = F.when(some, remove(F.when(some, body).otherwise(F.lit("")), F.when(some, F.col("__found.ranges")).otherwise(F.array()))).otherwise(body)
    return found.withColumn(text, clean).drop("__found", "__hit")
