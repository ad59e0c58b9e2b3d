"""The whole search of a batch of queries: lanes, fusion, diversity, reranking, thresholds, neighbours.

The lanes write small tables (terms, postings of the queries' terms, what they rank) while the search is
planned; what it returns is a plan over the ranked ids, written once, that texts are joined to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stackwise.config import Config
from stackwise.functions import text as T
from stackwise.operators import fusion, lexical, vector
from stackwise.session import saved


def search(chunks: DataFrame, docs: DataFrame, queries: DataFrame, config: Config | None = None, scope_docs: DataFrame | None = None, scorer=None, index=None) -> DataFrame:
    """Hits of queries (query_id, query, embedding or null) over chunks; query_id, rank, chunk_id, doc_id, title, heading, text, sibling_context, scores, mode.

    Every query has a mode of its own: one whose embedding failed, or has no chunk's width, is searched by words,
    and thresholds and the mode that is reported follow what was done. ``scope_docs`` (doc_id) is the allow-list of a
    metadata filter: an empty one gives no hits. ``index`` is a snapshot of a store of the chunks' search texts; without
    one the texts are read. ``scorer`` reranks: (ranked, top_k) -> ranked, of ``operators/rerank.py``.
    """
    config = config or Config()
    k = max(1, min(50, config.top_k))
    pool = fusion.pool_size(k)
    live = queries.where(F.length(T.trimmed(F.coalesce("query", F.lit("")))) > 0)
    corpus = chunks.select("chunk_id", "doc_id", F.col("search_text").alias("text"), "embedding")
    scope = None if scope_docs is None else corpus.join(scope_docs.select("doc_id"), "doc_id", "left_semi")
    vectors = (corpus if scope is None else scope).where("embedding is not null").select("chunk_id", "embedding")
    asked = config.search_mode
    if asked == "lexical":
        live = live.withColumn("lane", F.lit("lexical"))
    else:
        widths = vectors.select(F.size("embedding").alias("width")).distinct().withColumn("known", F.lit(True))
        live = live.withColumn("width", F.size("embedding")).join(widths, "width", "left")
        live = live.withColumn("lane", fusion.lane_mode(F.lit(asked), F.col("known"))).drop("width", "known")
    live = saved(live.select("query_id", "query", *[c for c in ("embedding",) if c in queries.columns], "lane"), "queries")
    lanes = live.select("query_id", "lane")
    lex = lexical.fts_lane(corpus.select("chunk_id", "text") if index is None else index, live.where("lane <> 'vector'"), pool, scope).select("query_id", "chunk_id", "score", "rank")
    none = F.lit(None).cast("double")
    if asked == "lexical":
        ranked = lex.withColumn("vector_score", none).withColumn("lexical_score", F.col("score"))
    else:
        lex = saved(lex, "lane")
        ranked = lex.join(lanes.where("lane = 'lexical'"), "query_id", "left_semi").withColumn("vector_score", none).withColumn("lexical_score", F.col("score"))
        vec = saved(vector.batch_topk(vectors, live.where("lane <> 'lexical'"), pool).select("query_id", "chunk_id", "score", "rank"), "lane")
        if asked == "vector":
            by_vector = vec.withColumn("vector_score", F.col("score")).withColumn("lexical_score", none)
        else:
            both = fusion.hybrid(vec, lex.join(lanes.where("lane <> 'lexical'"), "query_id", "left_semi"), config.rrf_vector_weight)
            by_vector = lexical.top(both, pool).select("query_id", "chunk_id", "score", "rank", "vector_score", "lexical_score")
        applies = fusion.mmr_applies(F.lit(None).cast("boolean"), F.lit(float(config.mmr_lambda)), F.col("lane") != "lexical")
        if config.mmr_lambda > 0:  # all of these have a query vector
            diverse = lanes.where(applies).select("query_id")
            by_vector = fusion.mmr(by_vector.join(diverse, "query_id", "left_semi").join(vectors, "chunk_id", "left"), config.mmr_lambda, k).drop("embedding")
        ranked = ranked.unionByName(by_vector)
    ranked = saved(ranked.join(lanes, "query_id"), "ranked")
    modes = fusion.effective_mode(ranked)
    if scorer is not None:
        pairs = ranked.join(live.select("query_id", "query"), "query_id").join(corpus.select("chunk_id", "text"), "chunk_id")
        ranked = saved(scorer(pairs, k).drop("query", "text", "rerank_error"), "reranked")
    else:
        ranked = ranked.withColumn("reranked", F.lit(False))
    # a query that was not reranked has the scores of its lanes, which no threshold of a reranker is meant for
    ranked = fusion.threshold(ranked, config.similarity_threshold, F.col("lane"), F.col("reranked")).drop("lane", "reranked").where(F.col("rank") <= k)
    found = ranked.join(vector.only(chunks, ranked, "chunk_id").select("chunk_id", "doc_id", "idx", "heading", "text"), "chunk_id")
    if config.sibling_chunks > 0:
        found = saved(found, "found")
    found = vector.with_neighbours(found, chunks, config.sibling_chunks)
    titled = found.join(docs.select("doc_id", F.col("title").alias("_title")), "doc_id", "left").withColumn("document_title", F.coalesce("_title", F.col("doc_id").cast("string"))).drop("_title")
    return titled.join(modes, "query_id", "left")


def search_variants(chunks: DataFrame, docs: DataFrame, variants: DataFrame, config: Config | None = None, **options) -> DataFrame:
    """variants (query_id, variant, query, embedding): each searched with twice the top-k, merged by the best score of a chunk."""
    from dataclasses import replace

    config = config or Config()
    k = max(1, min(50, config.top_k))
    v = variants.withColumn("_id", F.struct("query_id", "variant"))
    hits = search(chunks, docs, v.select(F.to_json("_id").alias("query_id"), "query", "embedding"), replace(config, top_k=min(50, 2 * k)), **options)
    keys = v.select(F.to_json("_id").alias("_key"), F.col("query_id").alias("_query"))
    flat = hits.join(keys, F.col("query_id") == F.col("_key")).select(F.col("_query").alias("query_id"), "chunk_id", "score")
    return fusion.best_of_variants(flat, k)
