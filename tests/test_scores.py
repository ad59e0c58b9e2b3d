"""The whole fusion of both lanes without the pairs of queries and chunks."""

import random

import pytest
from pyspark.sql import functions as F

from stackwise.operators import fusion, lexical

WORDS = [f"w{i}" for i in range(40)]


@pytest.mark.parametrize("kind", ["long", "string"])
def test_places_and_fusion_equal_those_of_pairs(spark, monkeypatch, kind):
    rng = random.Random(7)
    text = lambda n: " ".join(rng.choice(WORDS[: rng.choice([3, 10, 40])]) for _ in range(n))
    c = spark.createDataFrame([(i, text(rng.randint(0, 4))) for i in range(260)], "chunk_id long, text string").withColumn("chunk_id", F.col("chunk_id").cast(kind)).repartition(3)
    asked = {1: "w0 w1", 2: "w39", 3: "w2 w17 w30 w2", 4: "nothing here", 5: "w5 w6 w7 w8 w9"}
    q = spark.createDataFrame(list(asked.items()), "query_id long, query string")
    v = c.select("chunk_id", F.array(F.lit(1.0), F.pmod(F.hash("chunk_id"), F.lit(9)).cast("double")).alias("embedding"))
    qv = q.select("query_id", F.array(F.lit(1.0), F.col("query_id").cast("double")).alias("embedding")).where("query_id <> 3")
    monkeypatch.setattr(lexical, "PLACED", 2)  # several passes
    pairs = lexical.Pairs(lexical.bm25(c, q)).within(q)
    whole, all_of = [], lexical.Scores.all
    monkeypatch.setattr(lexical.Scores, "all", lambda self, k=None: (whole.append(k), all_of(self, k))[1])
    scores = lexical.bm25_scores(c, q)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(scores.counts()) == rows(pairs.counts())
    wanted = q.select("query_id").crossJoin(c.select("chunk_id").sample(0.3, 5))
    assert rows(scores.of(wanted).select("query_id", "chunk_id", "score")) == rows(pairs.of(wanted).select("query_id", "chunk_id", "score"))
    assert rows(scores.places(wanted, c)) == rows(pairs.places(wanted, c))
    mixed = lambda x: rows(fusion.memory_hybrid(v, q, qv, x, c, 3).select("query_id", "chunk_id", "score", "rank"))
    assert mixed(scores) == mixed(pairs.scores)
    assert None not in whole  # no table of all matches is made
