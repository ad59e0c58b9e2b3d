"""Fusion of ranked lanes, diversity, reranking and variants of a query."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from stackwise.operators import lexical, vector
from stackwise.session import saved, ship

RRF_K = 60


def pool_size(top_k: int) -> int:
    """Candidates of a lane."""
    return min(max(4 * top_k, 20), 200)


def pool_sizes(top_k: Column) -> Column:
    """The same of a column, for queries that ask for numbers of their own."""
    return F.least(F.greatest(4 * top_k, F.lit(20)), F.lit(200)).cast("int")


def hits_asked(top_k: Column) -> Column:
    """How many hits a query gets that asks for so many."""
    return F.greatest(F.lit(1), F.least(F.lit(50), top_k))


def rrf(lanes: list[tuple[DataFrame, float]], k: int = RRF_K) -> DataFrame:
    """query_id, chunk_id, score: sum of weight / (k + rank) over lanes of (query_id, chunk_id, rank)."""
    parts = [lane.select("query_id", "chunk_id", (F.lit(float(w)) / (F.lit(k) + F.col("rank"))).alias("part")) for lane, w in lanes]
    all_parts = parts[0]
    for p in parts[1:]:
        all_parts = all_parts.unionByName(p)
    return all_parts.groupBy("query_id", "chunk_id").agg(F.sum("part").alias("score"))


def hybrid(vector: DataFrame, lexical: DataFrame, weight: float = 1.0, k: int = RRF_K) -> DataFrame:
    """Both lanes (query_id, chunk_id, score, rank) fused, divided by the best sum there can be; keeps each lane's score."""
    v = vector.select("query_id", "chunk_id", F.col("score").alias("vector_score"), F.col("rank").alias("vector_rank"))
    x = lexical.select("query_id", "chunk_id", F.col("score").alias("lexical_score"), F.col("rank").alias("lexical_rank"))
    both = v.join(x, ["query_id", "chunk_id"], "full")
    part = lambda rank, w: F.coalesce(F.lit(float(w)) / (F.lit(k) + F.col(rank)), F.lit(0.0))
    best = (weight + 1) / (k + 1)
    return both.withColumn("score", (part("vector_rank", weight) + part("lexical_rank", 1)) / F.lit(best))


def effective_mode(ranked: DataFrame) -> DataFrame:
    """query_id, mode, of ranked (query_id, lane, both lanes' scores): vector and lexical as searched, else hybrid only where some row has both scores."""
    both = F.max(F.col("vector_score").isNotNull() & F.col("lexical_score").isNotNull())
    lane = F.first("lane")
    return ranked.groupBy("query_id").agg(F.when(lane.isin("vector", "lexical"), lane).when(both, "hybrid").otherwise("lexical").alias("mode"))


def lane_mode(requested: Column, embedded: Column) -> Column:
    """What a query is searched by: the vector modes need a query vector and chunks with vectors of its width, else the search is lexical."""
    return F.when((requested == "lexical") | ~F.coalesce(embedded, F.lit(False)), "lexical").when(requested == "auto", "hybrid").otherwise(requested)


def mmr_applies(asked: Column, lam: Column, has_vector: Column) -> Column:
    """Whether results are diversified: if the request says so, or the configuration where it says nothing, and always with a weight and a query vector."""
    return F.coalesce(asked, lam > 0) & (lam > 0) & has_vector


def depth_of(top_k: int, k: int = RRF_K) -> int:
    """How deep both lanes have to be read for the exact top of their fusion.

    Each of the lexical lane's first ``top_k`` has 1 / (k + top_k) at least. A candidate that is beyond the depth n in
    both lanes has 2 / (k + n + 1) at most, which is less from n = k + 2 * top_k on: the threshold is known beforehand.
    """
    return k + 2 * top_k


def memory_hybrid(corpus: DataFrame, queries: DataFrame, vectors: DataFrame, lexical_scores: DataFrame | lexical.Scores, candidates: DataFrame, top_k: int, k: int = RRF_K) -> DataFrame:
    """query_id, chunk_id, score, both lanes' places, rank: the exact top of both lanes fused with equal weights, without pools.

    Both lanes rank all ``candidates`` (chunk_id) that they have, the lexical one those without a match last, by id.
    ``corpus`` are vectors (chunk_id, embedding), ``queries`` (query_id), ``vectors`` the vectors of some of them and
    ``lexical_scores`` (query_id, chunk_id, score >= 0) the matches among the candidates, or what makes their scores without pairs. A threshold algorithm: only what is in
    one of the lanes' first ``depth_of(top_k)`` can win, and of that the place in the other lane is counted.
    """
    depth = depth_of(top_k, k)
    every = saved(candidates.select("chunk_id").distinct(), "candidates")
    q = saved(queries.select("query_id").distinct(), "queries")
    c = saved(corpus.select("chunk_id", "embedding").join(every, "chunk_id", "left_semi"), "vectors")
    v = vectors.select("query_id", "embedding").join(q, "query_id", "left_semi")
    x = (lexical.Pairs(lexical_scores) if isinstance(lexical_scores, DataFrame) else lexical_scores).within(q)

    first_v = vector.batch_topk(c, v, depth).select("query_id", "chunk_id", F.col("rank").cast("long").alias("vector_place"))
    first_x = x.best(depth).select("query_id", "chunk_id", F.col("rank").cast("long").alias("lexical_place"))
    # queries with fewer matches go on with the smallest ids that do not match: they are among the first ``depth`` ids
    few = q.join(x.counts(), "query_id", "left").withColumn("n", F.coalesce("n", F.lit(0))).where(F.col("n") < depth)
    ids = [r.chunk_id for r in every.orderBy("chunk_id").limit(depth).collect()]
    rest = saved(few.withColumn("chunk_id", F.explode(F.array(*map(F.lit, ids)).cast(f"array<{every.schema['chunk_id'].dataType.simpleString()}>"))), "few")
    rest = rest.join(x.of(rest), ["query_id", "chunk_id"], "left_anti")
    rest = rest.withColumn("lexical_place", F.col("n") + F.row_number().over(Window.partitionBy("query_id").orderBy("chunk_id"))).where(F.col("lexical_place") <= depth)
    first_x = first_x.unionByName(rest.select("query_id", "chunk_id", "lexical_place"))

    either = saved(first_v.join(first_x, ["query_id", "chunk_id"], "full"), "either")
    more_x = x.places(either.where("lexical_place is null"), every).withColumnRenamed("place", "_x")
    more_v = vector.places(c, v, either.where("vector_place is null")).select("query_id", "chunk_id", F.col("place").alias("_v"))
    both = either.join(more_x, ["query_id", "chunk_id"], "left").join(more_v, ["query_id", "chunk_id"], "left")
    both = both.select("query_id", "chunk_id", F.coalesce("vector_place", "_v").alias("vector_place"), F.coalesce("lexical_place", "_x").alias("lexical_place"))
    part = F.coalesce(F.lit(1.0) / (F.lit(k) + F.col("vector_place")), F.lit(0.0)) + F.lit(1.0) / (F.lit(k) + F.col("lexical_place"))
    return lexical.top(both.withColumn("score", part / F.lit(2 / (k + 1))), top_k)


def mmr_order(scores: np.ndarray, vectors: list, lam: float, top_k: int) -> list[int]:
    """Rows in their new order: picked greedily by lam * score - (1 - lam) * nearest picked, then the others, then those without a vector."""
    have = [i for i, v in enumerate(vectors) if v is not None and len(v)]
    if len(have) < 2:
        return list(range(len(vectors)))
    x = np.array([vectors[i] for i in have], dtype=float)
    near = np.clip(np.nan_to_num(x @ x.T), 0, 1)
    relevance = scores[have]
    left, closest, picked = np.ones(len(have), bool), np.zeros(len(have)), []
    for _ in range(min(len(have), max(3 * top_k, 12))):
        value = np.where(left, lam * relevance - (1 - lam) * closest, -np.inf)
        best = int(value.argmax())
        picked.append(best)
        left[best] = False
        closest = np.maximum(closest, near[best])
    rest = [i for i in range(len(have)) if left[i]]
    return [have[i] for i in picked + rest] + [i for i in range(len(vectors)) if vectors[i] is None or not len(vectors[i])]


def mmr(ranked: DataFrame, lam: float, top_k: int) -> DataFrame:
    """ranked (query_id, chunk_id, score, rank, embedding), a bounded pool for each query, with rank anew; scores stay."""
    ship(ranked.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank").reset_index(drop=True)
        order = mmr_order(pdf["score"].to_numpy(float), pdf["embedding"].tolist(), lam, top_k)
        out = pdf.iloc[order].reset_index(drop=True)
        out["rank"] = np.arange(1, len(out) + 1)
        return out

    return ranked.groupBy("query_id").applyInPandas(run, ranked.schema)


def rerank(ranked: DataFrame, scorer: Callable[[Column, Column], Column], top_k: int) -> DataFrame:
    """ranked (query_id, chunk_id, query, text, rank) scored anew by ``scorer(query, text)``, clamped to [0, 1].

    Only candidates that the scorer returns a score for stay; a query with none, or with one candidate only, keeps its order.
    """
    return reranked(ranked.withColumn("new", scorer(F.col("query"), F.col("text"))), top_k)


def rerank_by(ranked: DataFrame, scores: DataFrame, top_k: int) -> DataFrame:
    """The same by a reranker's answers: ``scores`` (query_id, chunk_id, new), joined by the ids."""
    return reranked(ranked.join(scores.select("query_id", "chunk_id", "new"), ["query_id", "chunk_id"], "left"), top_k)


def reranked(r: DataFrame, top_k: int, ties: str = "chunk_id") -> DataFrame:
    """``r`` by ``new``, where its query has any and more than one candidate; equal scores go by ``ties``."""
    w = Window.partitionBy("query_id")
    r = r.withColumn("some", F.max(F.col("new").isNotNull()).over(w) & (F.count("*").over(w) > 1))
    r = r.where(~F.col("some") | F.col("new").isNotNull()).withColumn("score", F.when(F.col("some"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("new")))).otherwise(F.col("score")))
    place = F.row_number().over(w.orderBy(F.when(F.col("some"), -F.col("score")).otherwise(F.col("rank").cast("double")), ties))
    return r.withColumn("rank", place).withColumn("reranked", F.col("some")).drop("new", "some").where(F.col("rank") <= top_k)


def best_of_variants(hits: DataFrame, k: int) -> DataFrame:
    """hits (query_id, variant, chunk_id, score): a chunk's best score over the variants of a query, the k best."""
    best = hits.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 6).desc(), "chunk_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k)


def threshold(hits: DataFrame, least: float, lane, by_reranker) -> DataFrame:
    """Applies to reranked results and to those of the vector lane only; ``lane`` and ``by_reranker`` are values or columns."""
    lane, by_reranker = F.lit(lane) if isinstance(lane, str) else lane, F.lit(by_reranker) if isinstance(by_reranker, bool) else by_reranker
    return hits.where(((lane != "vector") & ~by_reranker) | (F.col("score") >= least))
