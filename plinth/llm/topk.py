"""Exact top-k search by inner product: MaxScore over shards.

Terms are the dimensions of integer vectors.  The rows are dealt into shards; a
shard keeps, by term, its postings (a column, since nearly every value is there)
and the largest and least value.  For a query the bound of a term is the most
that it can add to any score of the shard.  Terms are ordered by bound.  The
``SEED_TERMS`` strongest of them pick k rows, which are scored in full; the least of
their scores is a floor under the k-th best.  The terms whose bounds together stay
below the floor are non-essential: no row gets into the best k by them alone.
Essential postings are traversed, the k rows that then look best lift the floor, and
the other terms are probed only while a row is still competitive.  Shards yield k
rows each, which are merged.

Shards stay where they are: each task holds one shard of at most about
``SHARD_ROWS`` rows while the queries, a stated set, stream past it in blocks.  What is
sent is every row once and every query once a shard.  The result is exact: every row
is either scored in full or shown to be out by its bound.

Defined results: vectors that are null, empty or hold a null or non-finite value
take no part.  A shorter vector counts as if filled up with zeros.  Equal rows
(id and vector) count once; an id names one row, so the rows of a query's own id
are not its candidates.  Ids keep their type; ties go to the smaller id.  With fewer
than k candidates all are returned.  Empty tables give an empty result.  Only id and
vector are read, so further columns never clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SHARD_ROWS, QUERY_BLOCK, SEED_TERMS, PROBE_STEP = 8_192, 128, 8, 8


class Shard:
    """Postings by term of a block of rows in order of their ids, and the bounds of terms."""

    def __init__(self, ids: list, vectors: np.ndarray):
        self.places: dict = {}
        for i, own in enumerate(ids):
            self.places.setdefault(own, []).append(i)
        self.ids, self.postings = ids, np.ascontiguousarray(vectors.T)  # one contiguous row a term
        self.most, self.least = self.postings.max(axis=1), self.postings.min(axis=1)

    def _floor(self, queries: np.ndarray, partial: np.ndarray, k: int) -> np.ndarray:
        """For each query the least full score of the k rows with the best partial ones."""
        seeds = np.argpartition(-partial, k - 1, axis=1)[:, :k]
        return np.array([(queries[q] @ self.postings[:, seeds[q]]).min() for q in range(len(queries))])

    def search(self, own: list, queries: np.ndarray, k: int) -> list[tuple[int, int, float]]:
        """(number of the query, place of the row, score) of the k best rows for each query, ties to the earlier place."""
        wide, rows_here = len(self.postings), self.postings.shape[1]
        q_full = np.zeros((len(queries), wide))
        q_full[:, : min(wide, queries.shape[1])] = queries[:, :wide]
        bound = np.where(q_full > 0, q_full * self.most, q_full * self.least)
        order = np.argsort(-bound, axis=1, kind="stable")
        place = np.argsort(order, axis=1)
        ranked = np.take_along_axis(bound, order, axis=1)
        left = np.hstack([np.cumsum(ranked[:, ::-1], axis=1)[:, ::-1], np.zeros((len(queries), 1))])  # left[q, t]: what terms t.. can still add
        mine = [self.places.get(i, []) for i in own]
        floor = np.full(len(queries), -np.inf)
        alone = lambda x: [x.__setitem__((q, at), -np.inf) for q, at in enumerate(mine) if at]  # noqa: E731  a query's own rows are no candidates
        if rows_here > k + max(map(len, mine), default=0):
            partial = np.where(place < SEED_TERMS, q_full, 0.0) @ self.postings
            alone(partial)
            floor = self._floor(q_full, partial, k)
        essential = (left[:, :-1] >= floor[:, None]).sum(axis=1)
        # The essential postings of all queries of the block are traversed at once; the other terms weigh nothing yet.
        partial = np.where(place < essential[:, None], q_full, 0.0) @ self.postings
        alone(partial)
        if np.isfinite(floor).all():
            floor = np.maximum(floor, self._floor(q_full, partial, k))
        out: list[tuple[int, int, float]] = []
        for q in range(len(queries)):
            at = int(essential[q])
            rows = np.flatnonzero((partial[q] + left[q, at] >= floor[q]) & (partial[q] > -np.inf))
            scores = partial[q, rows]
            while at < wide:
                step = order[q, at : at + PROBE_STEP]
                scores = scores + q_full[q, step] @ self.postings[np.ix_(step, rows)]
                at += len(step)
                keep = np.flatnonzero(scores + left[q, at] >= floor[q])
                rows, scores = rows[keep], scores[keep]
            best = np.lexsort((rows, -scores))[:k]
            out += [(q, int(rows[i]), float(scores[i])) for i in best]
        return out


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Rows of a list column, filled up with zeros."""
    lengths, values = np.diff(vectors.offsets.to_numpy()), vectors.flatten().to_numpy(zero_copy_only=False)
    wide = int(lengths.max())
    if (lengths == wide).all():
        return values.reshape(len(lengths), wide)
    out = np.zeros((len(lengths), wide))
    out[np.arange(wide) < lengths[:, None]] = values
    return out


def _stack(parts: list[np.ndarray]) -> np.ndarray:
    wide = max(p.shape[1] for p in parts)
    return np.vstack([np.pad(p, ((0, 0), (0, wide - p.shape[1]))) for p in parts])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector: str = "vector", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k best rows of ``vectors`` for each of ``queries``.

    Both have an id and an array of numbers whose products are exact in doubles.
    """
    def clean(df: DataFrame) -> DataFrame:
        v = F.col(vector).cast("array<double>")
        fine = F.col(id_col).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        return df.where(fine).select(F.col(id_col).alias("id"), v.alias("v")).distinct()

    rows, asked = clean(vectors), clean(queries)
    shards = max(1, -(-rows.count() // shard_rows))
    dealt = rows.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("asks"), "id", "v")
    sent = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("asks"), "id", "v")
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, parts, shard = None, [], [], None
        for batch in batches:
            key = np.column_stack([batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)])
            starts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            for begin, end in zip(starts, starts[1:], strict=False):
                if begin == end:
                    continue
                if key[begin, 0] != now:
                    now, ids, parts, shard = key[begin, 0], [], [], None
                piece = batch.slice(begin, end - begin)
                if not key[begin, 1]:
                    ids += piece.column(2).to_pylist()
                    parts.append(_matrix(piece.column(3)))
                    continue
                if shard is None and ids:
                    shard, parts = Shard(ids, _stack(parts)), []
                for at in range(0, piece.num_rows if ids else 0, QUERY_BLOCK):
                    block = piece.slice(at, QUERY_BLOCK)
                    own = block.column(2).to_pylist()
                    found = shard.search(own, _matrix(block.column(3)), k)
                    q, i = [x[0] for x in found], [x[1] for x in found]
                    yield pa.RecordBatch.from_arrays([block.column(2).take(pa.array(q, pa.int64())), pa.array([ids[x] for x in i], block.schema.field(2).type), pa.array([x[2] for x in found], pa.float64())], ["query_id", "vec_id", "score"])

    # A shard's rows come first, in order of their ids, and then the queries.
    streams = dealt.unionByName(sent).repartition(4 * shards, "shard").sortWithinPartitions("shard", "asks", "id")
    found = streams.mapInArrow(run, f"query_id {kind}, vec_id {kind}, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def integer_vectors(rows: DataFrame, vector: str = "embedding", scale: int = 64) -> DataFrame:
    """``vector``: floor(scale * x) of each component as double; null and non-finite ones stay so."""
    whole = F.transform(F.col(vector).cast("array<double>"), lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).otherwise(F.floor(x * F.lit(float(scale))).cast("double")))
    return rows.withColumn("vector", whole)
