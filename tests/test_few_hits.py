"""Texts are not shuffled for the few hits that they are joined to."""

from pyspark.sql import functions as F

from stackwise import queries
from stackwise.operators import vector


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hits_go_to_the_documents(spark, sf):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "60k")
    try:
        recall, reranked = (queries.QUERIES[name](spark, sf) for name in ("eval_context_recall", "join_rerank"))
        assert "hashpartitioning(chunk_id" not in plan(recall) and recall.count() > 0
        assert "MapInArrow" not in plan(reranked) and reranked.count() > 0  # ranked once, before
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_chunks_of_hits_are_found_before_vectors_are_joined(spark):
    docs = spark.range(50).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("idx"), F.lit(None).cast("string").alias("heading"), F.concat(F.lit("t"), F.col("id")).alias("text"))
    chunks = docs.join(spark.range(40).select(F.col("id").alias("doc_id"), F.lit(1.0).alias("embedding")), "doc_id", "left").select((F.col("doc_id")).alias("chunk_id"), "*")
    hits = spark.range(3, 6).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("idx"))
    deep = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    few = vector.only(chunks, hits, "doc_id")
    assert sorted(r.text for r in few.collect()) == ["t3", "t4", "t5"]
    for p in (deep(few), deep(vector.with_neighbours(hits, chunks, 1))):
        assert "Join LeftSemi" in p and p.rindex("Join LeftSemi") > p.rindex("Join LeftOuter")
