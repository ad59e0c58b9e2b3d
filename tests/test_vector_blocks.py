"""Vectors by blocks: all pairs without a shuffle, and of each task no more than k a query."""

from pyspark.sql import functions as F

from stackwise.functions import vectors as V
from stackwise.operators import vector


def test_all_pairs_and_counts_equal_column_expressions(spark, monkeypatch):
    c = spark.range(60).select(F.col("id").alias("chunk_id"), F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.sin(i * F.col("id")) / 2).alias("embedding")).repartition(3)
    q = c.where("chunk_id % 7 = 0").withColumnRenamed("chunk_id", "query_id")
    p = vector.pairs(c, q)
    rows = lambda df: sorted((r.query_id, r.chunk_id, round(r.score, 6)) for r in df.collect())
    want = rows(p.select("query_id", "chunk_id", V.unit_dot(F.col("query_embedding"), F.col("embedding")).alias("score")))
    monkeypatch.setattr(vector, "MOST_ROWS", 50)
    monkeypatch.setattr(vector, "SLAB", 40)
    got = vector.dots(c, q, block=8)
    assert "Exchange hash" not in got._jdf.queryExecution().executedPlan().toString() and rows(got) == want
    cos = p.select("query_id", "chunk_id", F.round(V.cosine(F.col("query_embedding"), F.col("embedding")), 6).alias("score")).where("score > 0")
    assert sorted(map(tuple, vector.matched(c, q, block=8).collect())) == sorted(map(tuple, cos.groupBy("query_id").count().collect()))


def test_a_task_returns_k_a_query_whatever_its_batches(spark):
    c = spark.range(4000).select(F.col("id").alias("chunk_id"), F.array(F.lit(1.0), (F.col("id") * 37 % 4000) / 4000).alias("embedding")).coalesce(1)
    q = c.where("chunk_id < 3").withColumnRenamed("chunk_id", "query_id")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    seen = []
    keep = vector.top
    try:
        vector.top = lambda df, k, **o: seen.append(df.count()) or keep(df, k, **o)
        best = vector.batch_topk(c, q, 5).collect()
    finally:
        vector.top = keep
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(best) == 15 and seen == [15]
