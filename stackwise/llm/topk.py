"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists.

The candidates are dealt to blocks by a hash of their id, the queries to blocks of their own,
and every block of candidates meets every block of queries in one task (a query's rows against
all rows, in blocks). In a task each dimension has its list of candidates sorted by value. A
query walks all lists at once from their best end (the top where its weight is positive, the
bottom where negative), scores every candidate it comes across, and stops when the bound - the
score of a vector made of the values at the walk's depth - cannot beat its kth result.
Then k rows a query and block are left, of which a window keeps the best.

Values are integers (floor(256 * x)), so sums are exact in doubles.

Defined results: vectors that are null, empty or hold null or non-finite components take no
part, nor does a row without an id; a pair of different lengths has no score; ties go to the
smaller id; repeated ids are candidates each, but a query meets no row of its own id; an empty
table gives no rows; other columns are ignored, whatever they are called.

On vectors whose components are alike in size the bound stops no walk early, as any exact method
has it there; it does where few components count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from stackwise.session import ship

CANDIDATES_PER_BLOCK = 8192
QUERIES_PER_BLOCK = 2048
#: Rows of every list read between two looks at the bound.
STRIDE = 16


def usable(v: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, finite)


def quantised(v: Column, scale: float = 256.0) -> Column:
    return F.transform(v, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double"))


class SortedLists:
    """Candidates with a list for each dimension, ascending by value."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], x[order]
        self.lists = np.argsort(self.x, axis=0, kind="stable").astype(np.int32)  # [depth, dimension]

    def best(self, query_id: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best, by score and then id."""
        n = len(self.ids)
        dims = np.flatnonzero(q)
        up = q[dims] > 0
        own = slice(np.searchsorted(self.ids, query_id), np.searchsorted(self.ids, query_id, "right"))
        seen = np.zeros(n, dtype=bool)
        seen[own] = True
        rows = np.zeros(0, dtype=np.int64)
        scores = np.zeros(0)
        depth = 0
        while depth < n:
            stop = min(n, depth + STRIDE)
            if len(dims):
                fresh = np.zeros(n, dtype=bool)
                fresh[self.lists[n - stop : n - depth, dims[up]]] = True
                fresh[self.lists[depth:stop, dims[~up]]] = True
                fresh &= ~seen
            else:
                fresh = ~seen
                stop = n
            new = np.flatnonzero(fresh)
            seen |= fresh
            rows, scores = np.concatenate([rows, new]), np.concatenate([scores, self.x[new] @ q])
            top = np.lexsort((rows, -scores))[:k] if len(rows) <= 4 * k else self._top(rows, scores, k)
            rows, scores = rows[top], scores[top]
            depth = stop
            if seen.all():
                break
            if len(rows) == k:
                last = np.where(up, self.lists[n - stop, dims], self.lists[stop - 1, dims])
                # rows not seen score at most this; an equal score could still have a smaller id
                if self.x[last, dims] @ q[dims] < scores[-1]:
                    break
        return self.ids[rows], scores

    @staticmethod
    def _top(rows: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
        keep = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return keep[np.lexsort((rows[keep], -scores[keep]))[:k]]


def by_length(ids: pa.ChunkedArray, vectors: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and a matrix of the vectors of each length, from the flat values."""
    if not len(vectors):
        return {}
    v = vectors.combine_chunks()
    flat, ends = v.flatten().to_numpy(zero_copy_only=False), np.cumsum(v.value_lengths().to_numpy(zero_copy_only=False))
    size = np.diff(np.r_[0, ends])
    ids = ids.to_numpy()
    out = {}
    for w in np.unique(size):
        at = np.flatnonzero(size == w)
        out[int(w)] = ids[at], flat[(ends[at] - w)[:, None] + np.arange(w)]
    return out


def search(df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """query_id, rank, vec_id, score (long): the k best other rows of every row that is a query."""
    spark = ship(df.sparkSession)
    rows = df.where(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col), scale).alias("v"), is_query.alias("q"))
    n, n_queries = rows.agg(F.count("*"), F.count_if("q")).first()
    blocks, query_blocks = max(1, -(-n // CANDIDATES_PER_BLOCK)), max(1, -(-n_queries // QUERIES_PER_BLOCK))
    part = lambda m: F.pmod(F.xxhash64("id"), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    candidates = rows.select("id", "v", part(blocks).alias("block"), every(query_blocks).alias("query_block"))
    queries = rows.where("q").select("id", "v", part(query_blocks).alias("query_block"), every(blocks).alias("block"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        lists = {w: SortedLists(*x) for w, x in by_length(left["id"], left["v"]).items()}
        for w, (ids, vectors) in by_length(right["id"], right["v"]).items():
            for query_id, q in zip(ids.tolist(), vectors) if w in lists else ():
                found, scores = lists[w].best(query_id, q, k)
                out[0] += [query_id] * len(found)
                out[1] += found.tolist()
                out[2] += scores.astype(np.int64).tolist()
        return pa.table([pa.array(c, pa.int64()) for c in out], names=["query_id", "vec_id", "score"])

    found = candidates.groupBy("block", "query_block").cogroup(queries.groupBy("block", "query_block")).applyInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
