"""The lexical lanes by blocks: nothing is shuffled for the index, and the best of each task give the same as all pairs."""

import random

from pyspark.sql import functions as F

from stackwise.operators import lexical
from stackwise.operators.store import postings_of

WORDS = "rain river rivers rainbow stone été the then there other of zq ab 知识・库 x1 x12 the_end aaaa".split()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def corpus(spark, n, kind):
    rng = random.Random(n)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 12)))) for i in range(n)]
    return spark.createDataFrame(rows, "chunk_id long, text string").withColumn("chunk_id", F.col("chunk_id").cast(kind))


def test_the_index_is_made_without_a_shuffle(spark):
    df = spark.range(100).select(F.col("id").alias("chunk_id"), F.lit("rain on the river").alias("text"))
    assert "Exchange" not in plan(postings_of(df, "text")) and "Sort" not in plan(postings_of(df, "text"))


def test_the_best_of_tasks_are_those_of_all_pairs(spark, monkeypatch):
    c = corpus(spark, 300, "string").repartition(5)
    q = spark.createDataFrame([(i, " ".join(random.Random(i).choices(WORDS, k=1 + i % 4))) for i in range(12)], "query_id long, query string")
    rows = lambda df: sorted((r.query_id, r["rank"], r.chunk_id, r.score) for r in df.collect())
    want = rows(lexical.top(lexical.bm25(c, q), 7))
    monkeypatch.setattr(lexical, "CELLS", 500)  # many blocks
    best = lexical.bm25(c, q, k=7)
    assert "Exchange" not in plan(best) and rows(lexical.top(best, 7)) == want
    monkeypatch.setattr(lexical, "BATCH", 5)  # several passes
    assert rows(lexical.top(lexical.bm25(c, q, k=7), 7)) == want
    raw = lexical.phrases(c, q).withColumn("score", F.col("score") / (F.col("score") + 1))
    assert rows(lexical.fts_lane(c, q, 7)) == rows(lexical.top(raw.unionByName(lexical.like_fallback(c, q)), 7))


def test_matchers_equal_plain_loops():
    known = ["the", "there", "her", "aaa", "rive", "été"]
    match = lexical.Folded(known)
    for word in ("there", "otherthere", "aaaaa", "rivers", "étÉté", "th", ""):
        low = word.lower()
        want = {i: n for i, t in enumerate(known) if (n := sum(low.startswith(t, at) for at in range(len(low))))}
        assert match(word) == want
    assert lexical.Tokens(["x1", "知识", "・库", "of"])("x1") == {0: 1} and lexical.Tokens(["知识", "・库"])("知识・库") == {0: 1, 1: 1}
    assert lexical.Parts(["é", "te", "zz"])("éte") == {0: 1, 1: 1}
