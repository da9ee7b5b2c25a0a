"""MinHash near-duplicates by an inverted join over signature coordinates.

1. Every text becomes its set of word shingles (64-bit hashes) and a MinHash
   signature.  Texts with equal sets form a class, of which one goes on, so
   exact copies never meet as pairs.
2. Classes are posted under each (coordinate, value) of their signature.  A
   value that one class alone has can match nothing and is skipped.  Values are
   ordered from rare to frequent, and a class is posted under its prefix only:
   two signatures that agree in ``match`` of ``coords`` places share a value in
   their first ``coords - match + 1``.  A class with fewer than ``match`` shared
   values is skipped whole.
3. Collisions are merged in three rounds.  First every posting list links its
   members to one of them; lists whose members are already one component are
   skipped from then on.  Then each member meets its best partner outside its
   component, and last all pairs across components.  Long lists are dealt in
   blocks.  A pair that meets in several lists counts in the one of its lowest
   common prefix coordinate.  Only pairs above the match threshold are kept whose
   bitmaps allow the similarity: buckets that just one of two sets fills give a
   sure lower bound of their difference, so no link is lost by that.  Bitmaps have
   at most ``MOST_BITS`` buckets, whatever a text's length, so a task holds at most two
   blocks of them; sets beyond are pruned less and confirmed more.  Every pair left
   is confirmed on the full shingle sets.
4. Links become components by hooking and pointer jumping, as joins.

A pair with similarity 0.8 is missed with a chance of 3e-7 (fewer than 34 of 64
equal coordinates); nothing that is not confirmed is ever linked.  No list is
cut short, and no set of links is expanded within a component.

Defined results: a null or blank text has an empty set and is its own component;
a text with fewer words than a shingle is one shingle; repeated rows and equal
texts share a component; a row with a null id keeps a null component and stays.
Ids keep their type.  An empty table gives an empty result.  Only the id and the text
are read, so further columns never clash; ``keep_first`` passes them through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, spread_join

COORDS, MATCH = 64, 34  # at most 64 coordinates: prefixes are kept as bits of a long
BLOCK = 1024
LEAST_BITS, MOST_BITS = 4096, 1 << 18
_MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_SHIFT = np.uint64(29)


class _WordHashes(dict):
    """Hashes of words met so far; emptied when it grows large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingle_set(text: bytes, words_each: int, hashes: dict) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text."""
    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(words_each, len(w))
    with np.errstate(over="ignore"):
        h = np.full(len(w) - width + 1, width, np.uint64)
        for j in range(width):
            h = (h ^ w[j : len(w) - width + 1 + j]) * _MIX1
            h ^= h >> _SHIFT
            h *= _MIX2
            h ^= h >> np.uint64(32)
    return np.unique(h)


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """Filled buckets of a set, eight or more for each shingle up to ``MOST_BITS`` in all."""
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (8 * max(1, len(shingles)) - 1).bit_length()))
    bits = np.zeros(size, bool)
    bits[(shingles & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").view(np.uint64)


def _permutations(coords: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(1, 2**63, (coords, 1), dtype=np.uint64) | np.uint64(1), rng.integers(0, 2**63, (coords, 1), dtype=np.uint64)


def signature(shingles: np.ndarray, mult: np.ndarray, add: np.ndarray) -> np.ndarray:
    out = np.full(len(mult), 2**32 - 1, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), 2048):  # memory stays bounded for very long texts
            out = np.minimum(out, ((shingles[None, at : at + 2048] * mult + add) >> np.uint64(32)).min(axis=1))
    return out.astype(np.uint32).view(np.int32)


def _sketch(docs: DataFrame, id_col: str, text: str, words_each: int, coords: int) -> DataFrame:
    """(doc, state, n, digest, sig) of every row; state is a hash of the text, sig is null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, (mult, add) = _WordHashes(), _permutations(coords)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n, digest, sig = [], [], []
                for t in part.column(2).cast(pa.binary()).to_pylist():
                    s = shingle_set(t or b"", words_each, hashes)
                    n.append(len(s))
                    digest.append(xxhash.xxh3_128_digest(s.tobytes()))
                    sig.append(signature(s, mult, add) if len(s) else None)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.list_(pa.int32()))], ["doc", "state", "n", "digest", "sig"])

    body = F.col(f"`{text}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc"), F.xxhash64(body).alias("state"), body.alias("text"))
    return rows.mapInArrow(run, f"doc {rows.schema['doc'].dataType.simpleString()}, state long, n long, digest binary, sig array<int>")


def _sets(docs: DataFrame, text: str, words_each: int) -> DataFrame:
    """(digest, shingles, bits) of every row: the sorted hashes and the bitmap, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                found = [shingle_set(t or b"", words_each, hashes) for t in batch.slice(at, 512).column(0).cast(pa.binary()).to_pylist()]
                raw = [s.tobytes() for s in found]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in ([xxhash.xxh3_128_digest(s) for s in raw], raw, [bitmap(s).tobytes() for s in found])], ["digest", "shingles", "bits"])

    return docs.select(F.col(f"`{text}`").cast("string")).mapInArrow(run, "digest binary, shingles binary, bits binary")


def _agree(pairs: DataFrame, members: DataFrame, match: int) -> DataFrame:
    """The pairs (a, b) whose signatures agree in ``match`` coordinates."""
    sa = members.select(F.col("cid").alias("a"), F.col("sig").alias("sa"))
    sb = members.select(F.col("cid").alias("b"), F.col("sig").alias("sb"))

    @F.pandas_udf("boolean")
    def enough(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(np.fromiter((np.count_nonzero(p == q) >= match for p, q in zip(x, y, strict=True)), bool, len(x)))

    return pairs.join(sa, "a").join(sb, "b").where(enough("sa", "sb")).select("a", "b")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of the full sets."""
    sa = sets.select(F.col("cid").alias("a"), F.col("shingles").alias("sa"))
    sb = sets.select(F.col("cid").alias("b"), F.col("shingles").alias("sb"))

    @F.pandas_udf("boolean")
    def alike(x: pd.Series, y: pd.Series) -> pd.Series:
        out = np.zeros(len(x), bool)
        for i, (p, q) in enumerate(zip(x, y, strict=True)):
            p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
            both = len(np.intersect1d(p, q, assume_unique=True))
            out[i] = 100 * both >= percent * (len(p) + len(q) - both)
        return pd.Series(out)

    return pairs.join(sa, "a").join(sb, "b").where(alike("sa", "sb")).select("a", "b")


def _fold(bits: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps of as many words, by the union of their parts."""
    return np.bitwise_or.reduce(bits.reshape(-1, words), axis=0)


def _matches(group: pd.DataFrame, match: int, percent: int, best_only: bool) -> list[tuple[int, int]]:
    """Pairs of one posting list (or of two of its blocks) across components that may be links."""
    ids, code, n = group["cid"].to_numpy(), group["root"].to_numpy(), group["n"].to_numpy()
    if (code == code[0]).all():
        return []
    block, mask, pos = group["mine"].to_numpy(), group["mask"].to_numpy(), int(group["pos"].iloc[0])
    crossing = group["i"].iloc[0] != group["j"].iloc[0]
    sig = np.stack(group["sig"].to_list())
    raw = [np.frombuffer(b, np.uint64) for b in group["bits"]]
    widths = np.array([len(b) for b in raw])
    tables, row = {}, {}  # by width: the bitmaps of sets at least as wide, folded to it, and the place of each
    for w in np.unique(widths).tolist():
        has = widths >= w
        tables[w], row[w] = np.stack([_fold(raw[i], w) for i in np.flatnonzero(has)]), np.cumsum(has) - 1
    lower = np.int64((1 << pos) - 1)
    found = []
    for k in range(len(ids)):
        ok = (code != code[k]) & (100 * np.minimum(n, n[k]) >= percent * np.maximum(n, n[k]))
        if crossing:
            ok &= block != block[k]
        if not best_only:
            ok[: k + 1] = False
        at = np.flatnonzero(ok)
        shared = np.zeros(len(at), np.int64)  # at most so many common shingles
        for w in np.unique(np.minimum(widths[at], widths[k])).tolist():
            own = np.minimum(widths[at], widths[k]) == w
            apart = np.bitwise_count(tables[w][row[w][at[own]]] ^ tables[w][row[w][k]]).sum(axis=1, dtype=np.int64)
            shared[own] = (n[at[own]] + n[k] - apart) // 2
        able = 100 * shared >= percent * (n[at] + n[k] - shared)
        at, shared = at[able], shared[able]
        if not len(at):
            continue
        equal = sig[at] == sig[k]
        enough = equal.sum(axis=1) >= match
        at, shared, equal = at[enough], shared[enough], equal[enough]
        if best_only and len(at):
            best = [int(np.argmax(shared / (n[at] + n[k] - shared)))]
            at, equal = at[best], equal[best]
        elif len(at):
            # The lists of a pair are the equal coordinates of both prefixes; it counts in the lowest.
            common = (equal << np.arange(equal.shape[1], dtype=np.uint64)).astype(np.uint64).sum(axis=1).view(np.int64) & mask[at] & mask[k]
            at = at[(common & lower) == 0]
        found += [(int(min(ids[k], ids[x])), int(max(ids[k], ids[x]))) for x in at]
    return found


def _across(postings: DataFrame, members: DataFrame, match: int, percent: int, best_only: bool) -> DataFrame:
    """Pairs (a, b) that share a posting list and are of two components.

    ``postings``: token, pos, cid, root; ``members``: cid, n, sig, bits, mask.
    Lists with one component are skipped.  A list of more than ``BLOCK`` members is
    dealt in blocks, and each pair of blocks is one group, so no task holds more
    than two blocks of a list.
    """
    mixed = postings.groupBy("token").agg(F.count("*").alias("g"), F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1")
    mixed = mixed.select("token", F.ceil(F.col("g") / BLOCK).cast("int").alias("blocks"))
    dealt = (
        postings.join(mixed, "token").withColumn("mine", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("token", "pos", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "cid", "root")
        .join(members, "cid")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for frame in batches:
            frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            key = frame[["token", "i", "j"]].to_numpy()
            ends = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            last = int(ends[-1]) if len(ends) else 0
            rest = frame.iloc[last:].reset_index(drop=True)
            out = [p for s, e in zip([0, *ends[:-1]], ends, strict=False) for p in _matches(frame.iloc[s:e], match, percent, best_only)]
            yield pd.DataFrame(out, columns=["a", "b"])
        if rest is not None and len(rest):
            yield pd.DataFrame(_matches(rest, match, percent, best_only), columns=["a", "b"])

    by = F.col("token"), F.col("i"), F.col("j")
    return dealt.repartition(*by).sortWithinPartitions(*by, "cid").mapInPandas(run, "a long, b long").distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", words_each: int = 5, percent: int = 80, coords: int = COORDS, match: int = MATCH
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    return _grouped(docs, id_col, text, words_each, percent, coords, match).select("doc_id", "n_shingles", "component_id", "kept")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words_each: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` of which one stays for each group of near copies: that of the smallest id.

    Rows that share the id count by their texts: of several texts of the group under the same
    id one stays, of identical rows (id and text) one; a row without an id stays.
    """
    own, state = F.col(f"`{id_col}`"), F.xxhash64(F.col(f"`{text}`").cast("string"))
    groups = cut(_grouped(docs, id_col, text, words_each, percent, COORDS, MATCH), "groups").where("kept and doc_id is not null")
    # One row for each text that stays and how many rows have it; a group is told by its root, so equal ids of other groups don't meet.
    first = groups.groupBy("doc_id", "root").agg(F.min("state").alias("state"))
    stays = groups.join(first, ["doc_id", "root", "state"]).groupBy("doc_id", "state").agg(F.count(F.lit(1)).alias("__rows"))
    stays = cut(stays.withColumnsRenamed({"doc_id": "__id", "state": "__state"}), "stays")
    kept = docs.withColumn("__own", state).join(stays, (own == F.col("__id")) & (F.col("__own") == F.col("__state")), "left").where(F.col("__id").isNotNull() | own.isNull())
    once = kept.where(F.coalesce("__rows", F.lit(1)) == 1)
    often = kept.where(F.col("__rows") > 1)
    return once.unionByName(often.dropDuplicates(["__id", "__state"])).select(*[F.col(f"`{c}`") for c in docs.columns])


def _grouped(docs: DataFrame, id_col: str, text: str, words_each: int, percent: int, coords: int, match: int) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, state (hash of the text) and root (the group's number or the own digest) of each row."""
    if coords > 64:
        raise ValueError("a signature has 64 coordinates at most")
    feats = cut(_sketch(docs, id_col, text, words_each, coords), "sketch")
    classes = feats.where("n > 0").groupBy("digest").agg(F.min("doc").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    classes = cut(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")  # written, so the ids stay

    token = (F.col("pos").cast("long") * F.lit(2**32)) + F.col("val").cast("long")  # values are signed: still one to one
    tokens = classes.select("cid", F.posexplode("sig").alias("pos", "val")).select("cid", token.alias("token"))
    shared = tokens.groupBy("token").agg(F.count("*").alias("freq")).where("freq > 1")
    prefix = (
        tokens.join(shared, "token").groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("freq", "token"))).alias("t"))
        .where(F.size("t") >= match).select("cid", F.expr(f"slice(t, 1, size(t) - {match} + 1)").alias("t"))
    )
    prefix = cut(prefix, "prefix")
    pos = lambda t: F.floor((t + F.lit(2**31)) / F.lit(2**32)).cast("int")
    postings = prefix.select("cid", F.explode("t.token").alias("token")).withColumn("pos", pos(F.col("token")))
    mask = F.aggregate("t", F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), pos(x["token"]))))
    members = classes.join(prefix.select("cid", mask.alias("mask")), "cid")
    wanted = members.select(F.col("rep").alias("__rep"))
    sets = _sets(docs.join(wanted, F.col(f"`{id_col}`") == F.col("__rep"), "left_semi"), text, words_each).dropDuplicates(["digest"])
    members = cut(members.join(sets, "digest"), "members")
    sets = members.select("cid", "shingles")

    weighed = postings.join(members.select("cid", "n"), "cid")
    first = weighed.groupBy("token").agg(F.min(F.struct("cid", "n")).alias("lead"))
    star = (
        weighed.join(first, "token").where("lead.cid <> cid").where(f"100 * least(n, lead.n) >= {percent} * greatest(n, lead.n)")
        .select(F.col("lead.cid").alias("a"), F.col("cid").alias("b")).distinct()
    )
    links = cut(_confirm(_agree(star, members, match), sets, percent), "links")
    roots = members.select("cid", F.col("cid").alias("root"))
    for best_only in (True, False):
        roots = _merge(roots, links)
        pairs = _across(postings.join(roots, "cid"), members.select("cid", "n", "sig", "bits", "mask"), match, percent, best_only)
        links = cut(_confirm(pairs, sets, percent), "links")
    roots = _merge(roots, links)

    named = roots.join(members.select("cid", "digest", "rep"), "cid")
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    ids = spread_join(named, least, "root", "cid").select("digest", "component_id", "root")
    told = classes.select("digest", "rep", "cid").join(ids, "digest", "left")
    told = told.select("digest", F.coalesce("component_id", "rep").alias("component_id"), F.coalesce("root", "cid").alias("root"))
    found = spread_join(feats.select("doc", "state", "n", "digest"), told, "digest", "doc", "left")
    component = F.when(F.col("n") == 0, F.col("doc")).otherwise(F.col("component_id"))
    out = found.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("doc").isNotNull(), component).alias("component_id"), "state", F.coalesce("root", F.lit(-1)).alias("root"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _merge(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` (cid, root) after the links (a, b) between classes."""
    ra = roots.select(F.col("cid").alias("a"), F.col("root").alias("ra"))
    rb = roots.select(F.col("cid").alias("b"), F.col("root").alias("rb"))
    edges = links.join(ra, "a").join(rb, "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    moved = connected_components(edges, "near").select(F.col("node").alias("root"), F.col("root").alias("to"))
    return cut(spread_join(roots, moved, "root", "cid", "left").select("cid", F.coalesce("to", "root").alias("root")), "roots")
