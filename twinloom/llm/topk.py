"""Exact top-k search by distributed histogram selection.

All scores of a block of queries are computed in every pass. The first passes
count them in a histogram a query, over a score range that narrows to the bin
that holds the query's k-th score; the last pass emits the scores from that bin
upward, and a window ranks them.

Vectors are turned into integers, floor(1024 * x), once, in a written table whose
rows are numbered, and scores are their exact integer inner products. Edge cases:
vectors that are null, or hold a null or a component that is not finite, take no
part, and neither do vectors with another length than the query's; a query with
fewer than k candidates gets them all; equal scores are ranked by the smaller id;
components beyond 2**63 and scores beyond 2**63 - 1 either way count as these
limits; a query's own row is no candidate, but other rows with its id are; rows
that repeat are candidates each, and queries each, so that an id that repeats is
answered for each of its rows; null ids are never queries, and as candidates come
first in ties.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinloom.storage import written

SCALE = 1024
#: Queries a block; a block's vectors are what the driver holds and broadcasts.
BLOCK = 1024
BINS = 64
#: A bin is narrow enough when a query has at most this many times k scores from it upward.
SLACK = 8
#: Scores lie within this.
_MOST = 2**63 - 1


def quantised(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v, row): the rows that take part, numbered."""
    x = F.col(vector_col)
    sound = F.col("x").isNotNull() & ~F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    ints = F.transform("x", lambda c: F.floor(c * SCALE))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), x.cast("array<double>").alias("x")).where(sound).select("id", ints.alias("v"))
    return written(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")  # row numbers are fixed once written


def _matrix(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, integer matrix) for each vector length in the column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = np.asarray(column.flatten(), dtype=np.int64)
    ends = np.asarray(column.offsets) - column.offsets[0].as_py()
    lengths = np.diff(ends)
    return [
        (at := np.flatnonzero(lengths == n), flat[(ends[at][:, None] + np.arange(n))] if n else np.zeros((len(at), 0), np.int64))
        for n in np.unique(lengths)
    ]


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products; floats are used where they are exact, as they are faster, and Python's integers where 64 bits may not do."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = float(np.abs(a.astype(np.float64)).max()) * float(np.abs(b.astype(np.float64)).max()) * a.shape[1]
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < _MOST:
        return a @ b.T
    return np.clip(a.astype(object) @ b.astype(object).T, -_MOST, _MOST).astype(np.int64)


def _place(scores: np.ndarray) -> np.ndarray:
    """Scores as unsigned numbers in the same order: differences of any two fit."""
    return scores.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)


class _Scores:
    """Iterates over (queries, candidates' ids and whether they are null, scores, whether they are candidates) of the batches of a partition."""

    def __init__(self, rows: np.ndarray, vectors: list[np.ndarray]):
        self.rows = rows
        lengths = np.array([len(v) for v in vectors])
        self.by_length = {n: (at := np.flatnonzero(lengths == n), np.stack([vectors[i] for i in at])) for n in set(lengths.tolist())}

    def __call__(self, batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            ids, null = np.asarray(batch.column(0).fill_null(0)), np.asarray(batch.column(0).is_null())
            rows = np.asarray(batch.column(2))
            for at, m in _matrix(batch.column(1)):
                if m.shape[1] in self.by_length:
                    queries, q = self.by_length[m.shape[1]]
                    for lo in range(0, len(at), 2048):
                        own = at[lo : lo + 2048]
                        yield queries, ids[own], null[own], _dots(q, m[lo : lo + 2048]), self.rows[queries][:, None] != rows[own][None, :]


def _counts(scores: _Scores, low: np.ndarray, width: np.ndarray):
    """Per query: how many scores lie below ``low``, in each of BINS bins of the given width from there, and above them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(low), BINS + 2), np.int64)
        for queries, _, _, s, valid in scores(batches):
            u, first = _place(s), low[queries][:, None]
            b = np.where(u < first, 0, np.minimum((u - first) // width[queries][:, None], BINS).astype(np.int64) + 1)
            flat = (queries[:, None] * (BINS + 2) + b)[valid]
            total += np.bincount(flat.ravel(), minlength=total.size).reshape(total.shape)
        for part in np.array_split(np.flatnonzero(total.any(axis=1)), 8):
            if len(part):
                q, b = np.nonzero(total[part])
                yield pa.record_batch({"q": part[q].astype(np.int64), "b": b.astype(np.int64), "n": total[part][q, b]})

    return run


def _above(scores: _Scores, low: np.ndarray, k: int):
    """Rows (q, id, score) from ``low`` upward; of a partition's rows the k best of a query do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for queries, ids, null, s, valid in scores(batches):
            good = valid & (_place(s) >= low[queries][:, None])
            for r in np.flatnonzero(good.any(axis=1)):
                found = ids[good[r]], null[good[r]], s[r][good[r]]
                if queries[r] in kept:
                    found = tuple(np.concatenate(x) for x in zip(kept[queries[r]], found))
                best = np.lexsort((found[0], ~found[1], -found[2]))[:k]
                kept[queries[r]] = tuple(x[best] for x in found)
        if kept:
            q = np.concatenate([np.full(len(x[0]), k, np.int64) for k, x in kept.items()])
            ids, null, s = (np.concatenate(x) for x in zip(*kept.values()))
            yield pa.record_batch({"q": q, "id": pa.array(ids, pa.int64(), mask=null), "score": s})

    return run


def _block(data: DataFrame, ids: np.ndarray, rows: np.ndarray, vectors: list[np.ndarray], k: int) -> DataFrame:
    scores = _Scores(rows, vectors)
    n = len(ids)
    # |score| is at most the product of the norms; the largest norm of all rows is one aggregate
    top = data.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))).first()[0]
    bound = [min(_MOST, int(np.sqrt(float((v.astype(np.float64) ** 2).sum()) * (top or 0.0)) * 1.001) + 2) for v in vectors]
    low = np.array([2**63 - b for b in bound], np.uint64)  # as _place has them
    width = np.array([2 * b // BINS + 1 for b in bound], np.uint64)
    open_, cut = np.ones(n, bool), np.zeros(n, np.uint64)
    while open_.any():
        counted = data.mapInArrow(_counts(scores, low, width), "q long, b long, n long").groupBy("q", "b").agg(F.sum("n").alias("n"))
        hist = np.zeros((n, BINS + 2), np.int64)
        for r in counted.collect():  # at most BLOCK * BINS counts
            hist[r.q, r.b] = r.n
        from_top = hist[:, ::-1].cumsum(axis=1)[:, ::-1]
        for q in np.flatnonzero(open_):
            if from_top[q, 0] <= k * SLACK:
                open_[q] = False  # few candidates at all
                continue
            b = int(np.flatnonzero(from_top[q] >= k)[-1])  # the bin of the k-th score; 0 and BINS + 1 can't be
            edge, wide = int(low[q]) + (b - 1) * int(width[q]), int(width[q])
            if from_top[q, b] <= k * SLACK or wide == 1:
                open_[q], cut[q] = False, edge
            low[q], width[q] = edge, wide // BINS + 1 if wide > 1 else 1
    found = data.mapInArrow(_above(scores, cut, k), "q long, id long, score long")
    names = data.sparkSession.createDataFrame(pd.DataFrame({"q": np.arange(n), "query_id": ids, "query_row": rows}))
    return found.join(F.broadcast(names), "q").select("query_id", "query_row", "id", "score")


def top_k(vectors: DataFrame, id_col: str, vector_col: str, every: int = 100, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by ``every`` its k best others.

    Queries are taken in blocks of ``BLOCK``, so that driver and broadcast are bounded.
    """
    data = quantised(vectors, id_col, vector_col)
    queries = data.where(F.col("id") % every == 0)
    parts, after = [], None
    while True:
        todo = queries if after is None else queries.where(F.struct("id", "row") > F.struct(F.lit(after[0]).alias("id"), F.lit(after[1]).alias("row")))
        rows = todo.orderBy("id", "row").limit(BLOCK).collect()
        if not rows:
            break
        after = rows[-1].id, rows[-1].row
        parts.append(_block(data, np.array([r.id for r in rows], np.int64), np.array([r.row for r in rows], np.int64), [np.array(r.v, np.int64) for r in rows], k))
    if not parts:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    best = Window.partitionBy("query_id", "query_row").orderBy(F.col("score").desc(), F.col("id"))
    ranked = out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


TOP_K_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, q.r AS query_row, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1]::HUGEINT * z[2]))::BIGINT AS score
  FROM v q, v c WHERE q.vec_id % 100 = 0 AND c.r <> q.r AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, query_row ORDER BY score DESC, vec_id NULLS FIRST) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 10
"""
