"""Passages in documents: found where the texts are read."""

import random

from stackwise.operators import evaluate

WORDS = ["rain", "on", "the", "river", "stone", "étage", " gap", "a b", "x"]


def test_holders_shuffle_no_text_and_equal_all_pairs(spark, monkeypatch):
    rng = random.Random(3)
    text = lambda least, most: "".join(rng.choice(WORDS) + rng.choice([" ", "  ", "\n", "\t", "\x0b "]) for _ in range(rng.randint(least, most)))
    docs = [(i, text(0, 40)) for i in range(60)] + [(60, None), (61, ""), (7, "the river stone"), (62, "the river stone x")]
    cut = lambda t: t[(a := rng.randint(0, len(t))) : rng.randint(a, len(t))]
    passages = [(f"p{i}", cut(t)) for i, (_, t) in enumerate(docs) if t is not None] + [("e", ""), ("n", None), ("s", "ver st"), ("w", "e river s"), ("z", "no such words here")]
    d, p = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(passages, "item_id string, passage string")
    want = sorted((i, j) for i, t in docs for j, x in passages if t is not None and x is not None and x in t)
    found = evaluate.holders(d.coalesce(2), p)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == want
    monkeypatch.setattr(evaluate, "BATCH", 20)  # several passes
    assert sorted(map(tuple, evaluate.holders(d, p).collect())) == want
    assert evaluate.holders(d, p.where("false")).count() == 0 and evaluate.holders(d.where("false"), p).count() == 0
