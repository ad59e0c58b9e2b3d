import math
import random
import sqlite3
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from stackwise.config import Config
from stackwise.operators import fusion, lexical, rerank, vector
from stackwise.plans.search import search, search_variants

ABC = [(1, "the quick brown fox jumps over the lazy dog"), (2, "a fox is a wild animal"), (3, "totally different topic")]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_bm25_golden(spark):
    got = {r.chunk_id: r.score for r in lexical.bm25(frame(spark, ABC, "chunk_id long, text string"), frame(spark, [(1, "quick brown fox")], "query_id long, query string")).collect()}
    assert set(got) == {1, 2}
    assert math.isclose(got[1], 0.742847, abs_tol=1e-6) and math.isclose(got[2], 0.211833, abs_tol=1e-6)


def test_phrases_golden(spark):
    table = frame(spark, ABC + [(4, "filler one"), (5, "filler two")], "chunk_id long, text string")
    q = frame(spark, [(1, "fox"), (2, "quick brown fox")], "query_id long, query string")
    got = {(r.query_id, r.chunk_id): r.score for r in lexical.phrases(table, q).collect()}
    want = {(1, 2): 0.333686, (1, 1): 0.232585, (2, 1): 1.751411, (2, 2): 0.333686}
    assert set(got) == set(want) and all(math.isclose(got[k], v, abs_tol=1e-6) for k, v in want.items())
    # statistics are of the whole table whatever the scope
    scoped = lexical.phrases(table, q, scope=table.where("chunk_id = 1")).collect()
    assert {(r.query_id, r.chunk_id): r.score for r in scoped} == {k: v for k, v in got.items() if k[1] == 1}


def test_phrases_equal_sqlite(spark):
    rng = random.Random(3)
    words = ["erer", "aaa", "aaaa", "fox", "Quick", "库知识", "报销流程", "déjà", "ab", "thing"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))) for i in range(40)]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(text, tokenize='trigram')")
    db.executemany("INSERT INTO t(rowid, text) VALUES (?, ?)", rows)
    terms = ["aaa", "fox", "报销流", "erer"]
    want = dict(db.execute("SELECT rowid, -bm25(t) FROM t WHERE t MATCH ?", [" OR ".join(f'"{t}"' for t in terms)]).fetchall())
    got = lexical.phrases(frame(spark, rows, "chunk_id long, text string"), frame(spark, [(1, " ".join(terms))], "query_id long, query string")).collect()
    got = {r.chunk_id: r.score for r in got}
    assert set(got) == set(want) and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)


def test_short_terms_relax_and_fallback(spark):
    table = frame(spark, [(1, "reports zq here"), (2, "reports only"), (3, "年假 制度")], "chunk_id long, text string")
    q = frame(spark, [(1, "reports zq"), (2, "reports xx"), (3, "年假"), (4, "!!!")], "query_id long, query string")
    got = {(r.query_id, r.chunk_id) for r in lexical.fts_lane(table, q, 20).collect()}
    assert got == {(1, 1), (2, 1), (2, 2), (3, 3)}


def test_vector_order_and_ties(spark):
    c = frame(spark, [(1, [1.0, 0.0, 0.0]), (2, [0.0, 0.0, 1.0]), (3, [0.7, 0.7, 0.0]), (4, [-1.0, 0.0, 0.0]), (5, [1.0, 0.0]), (6, None), (7, [0.0, 0.0, -1.0])], "chunk_id long, embedding array<float>")
    q = frame(spark, [(1, [1.0, 0.1, 0.0]), (2, None)], "query_id long, embedding array<float>")
    a = [(r.chunk_id, r["rank"]) for r in vector.cosine_topk(c, q, 10).orderBy("rank").collect()]
    b = [(r.chunk_id, r["rank"]) for r in vector.batch_topk(c, q, 10).orderBy("rank").collect()]
    assert a == b == [(1, 1), (3, 2), (2, 3), (4, 4), (7, 5)]


def test_batches_do_not_change_ties(spark, monkeypatch):
    # cosines that are equal at six digits and not at nine
    c = frame(spark, [(i, [1.0, 1e-5 * (60 - i)]) for i in range(60)] + [(100 + i, [1.0, 1.0]) for i in range(20)], "chunk_id long, embedding array<double>")
    q = frame(spark, [(i, [1.0, 0.01 * i]) for i in range(7)], "query_id long, embedding array<double>")
    rows = lambda df: sorted((r.query_id, r["rank"], r.chunk_id, r.score) for r in df.collect())
    want = rows(vector.cosine_topk(c, q, 5))
    assert rows(vector.batch_topk(c, q, 5, block=1)) == rows(vector.batch_topk(c, q, 5, block=1000)) == want
    assert [r[2] for r in want if r[0] == 0] == [0, 1, 2, 3, 4]
    monkeypatch.setattr(vector, "BATCH", 2)  # queries in several passes
    assert rows(vector.batch_topk(c, q, 5)) == want


def test_queries_whose_embedding_failed_are_searched_by_words(spark):
    chunks, docs = world(spark)
    q = frame(spark, [(1, "alpha document", [1.0, 0.0]), (2, "alpha document", None)], "query_id long, query string, embedding array<float>")
    words = {(h.chunk_id, h["rank"], h.score) for h in search(chunks, docs, q, Config(search_mode="lexical")).where("query_id = 2").collect()}
    for mode in ("auto", "hybrid", "vector"):
        hits = search(chunks, docs, q, Config(search_mode=mode, mmr_lambda=0.3)).collect()
        assert {(h.chunk_id, h["rank"], h.score) for h in hits if h.query_id == 2} == words
        assert any(h.vector_score is not None for h in hits if h.query_id == 1)
    assert search(chunks, docs, q.withColumn("query", F.lit(" ")), Config()).count() == 0


def test_thresholds_and_modes_are_those_of_what_was_done(spark):
    """In mode vector, a query without a vector of the chunks' width is searched by words, said to be, and not cut."""
    chunks, docs = world(spark)
    q = frame(spark, [(1, "alpha document", [1.0, 0.0]), (2, "alpha document", None), (3, "alpha document", [1.0, 0.0, 0.0])], "query_id long, query string, embedding array<float>")
    hits = search(chunks, docs, q, Config(search_mode="vector", similarity_threshold=0.99)).collect()
    modes = {h.query_id: h["mode"] for h in hits}
    assert modes == {1: "vector", 2: "lexical", 3: "lexical"}
    assert [h.chunk_id for h in hits if h.query_id == 1] == [0] and sum(h.query_id == 2 for h in hits) == sum(h.query_id == 3 for h in hits) == 4


def test_pairs_are_dealt_to_many_tasks(spark):
    c = spark.range(400).select(F.col("id").alias("chunk_id"), F.array(F.lit(1.0), F.col("id") / 400).alias("embedding"))
    q = c.where("chunk_id < 5").withColumnRenamed("chunk_id", "query_id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = vector.pairs(c, q).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(tasks) > 1 and sum(r["count"] for r in tasks) == 2000


def test_every_candidate_is_ranked(spark):
    table = frame(spark, ABC + [(0, "nothing of it"), (4, "")], "chunk_id long, text string")
    got = lexical.ranked_all(table, frame(spark, [(1, "quick fox"), (2, "zz")], "query_id long, query string"), 4).collect()
    assert sorted((r.query_id, r["rank"], r.chunk_id) for r in got) == [(1, 1, 1), (1, 2, 2), (1, 3, 0), (1, 4, 3), (2, 1, 0), (2, 2, 1), (2, 3, 2), (2, 4, 3)]


def test_gates():
    from stackwise.config import resolve

    assert [resolve({"top_k": k}).top_k for k in (-3, 0, 7, 900, "x")] == [1, 1, 7, 50, 6]


def test_hybrid_golden(spark):
    v = frame(spark, [(1, "a", 0.9, 1), (1, "b", 0.8, 2)], "query_id long, chunk_id string, score double, rank int")
    x = frame(spark, [(1, "c", 0.9, 1), (1, "a", 0.5, 2)], "query_id long, chunk_id string, score double, rank int")
    got = {r.chunk_id: round(r.score, 6) for r in fusion.hybrid(v, x, 2).collect()}
    assert got == {"a": 0.994624, "b": 0.655914, "c": 0.333333}
    both = fusion.hybrid(v, x, 2)
    assert fusion.effective_mode(both.withColumn("lane", F.lit("hybrid"))).first()["mode"] == "hybrid"
    assert fusion.effective_mode(both.withColumn("lane", F.lit("vector"))).first()["mode"] == "vector"


def test_rrf_does_not_depend_on_lane_order(spark):
    rows = [(1, c, i + 1) for i, c in enumerate("abc")]
    a, b = frame(spark, rows, "query_id long, chunk_id string, rank int"), frame(spark, [(1, c, 3 - i) for i, c in enumerate("abc")], "query_id long, chunk_id string, rank int")
    one = {r.chunk_id: r.score for r in fusion.rrf([(a, 1), (b, 1)]).collect()}
    two = {r.chunk_id: r.score for r in fusion.rrf([(b, 1), (a, 1)]).collect()}
    assert all(math.isclose(one[k], two[k]) for k in one)


@pytest.mark.parametrize("lam,order", [(0.3, "pqrs"), (0.7, "pqrs"), (1.0, "prqs")])
def test_mmr_golden(lam, order):
    rows = {"p": (0.9, [1, 0]), "q": (0.8, [0.6, 0.8]), "r": (0.85, [0.8, 0.6]), "s": (0.95, None)}
    got = fusion.mmr_order(np.array([v[0] for v in rows.values()]), [v[1] for v in rows.values()], lam, 4)
    assert "".join(list(rows)[i] for i in got) == order


def test_rerank_keeps_only_scored(spark):
    r = frame(spark, [(1, 1, "q", "aa", 0.9, 1), (1, 2, "q", "b", 0.8, 2), (1, 3, "q", "cccc", 0.7, 3), (2, 9, "q", "zz", 0.1, 1)], "query_id long, chunk_id long, query string, text string, score double, rank int")
    out = fusion.rerank(r, lambda q, t: F.when(F.length(t) > 1, F.length(t) / F.lit(2.0)), 5).orderBy("query_id", "rank").collect()
    assert [(x.query_id, x.chunk_id, x.score, x["rank"]) for x in out] == [(1, 1, 1.0, 1), (1, 3, 1.0, 2), (2, 9, 0.1, 1)]


def world(spark):
    docs = frame(spark, [(i, f"title {i}") for i in range(4)], "doc_id long, title string")
    rows = [(10 * d + i, d, i, None if i else "head", t, t, v) for d in range(4) for i, (t, v) in enumerate([(f"alpha document {d}", [1.0, float(d)]), (f"beta fox {d}", [0.0, 1.0]), ("gamma", None)])]
    return frame(spark, rows, "chunk_id long, doc_id long, idx int, heading string, text string, search_text string, embedding array<float>"), docs


def test_search(spark):
    chunks, docs = world(spark)
    q = frame(spark, [(1, "alpha document", [1.0, 0.0]), (2, "   ", [1.0, 0.0])], "query_id long, query string, embedding array<float>")
    hits = search(chunks, docs, q, Config(top_k=3, mmr_lambda=0.5)).orderBy("query_id", "rank").collect()
    assert [h.query_id for h in hits] == [1, 1, 1] and hits[0].chunk_id == 0 and hits[0]["mode"] == "hybrid"
    assert hits[0].document_title == "title 0" and hits[0].sibling_context == "beta fox 0"
    # an allow-list that nothing matches gives no hits
    assert search(chunks, docs, q, Config(), scope_docs=docs.where("false")).count() == 0
    only = search(chunks, docs, q, Config(search_mode="vector", similarity_threshold=0.99, sibling_chunks=0), scope_docs=docs.where("doc_id = 0")).collect()
    assert [h.chunk_id for h in only] == [0] and only[0].sibling_context is None
    assert search(chunks, docs, q, Config(search_mode="lexical")).count() == 4


def test_variants(spark):
    chunks, docs = world(spark)
    v = frame(spark, [(1, 0, "alpha document 1", [1.0, 1.0]), (1, 1, "beta fox 2", [0.0, 1.0])], "query_id long, variant int, query string, embedding array<float>")
    got = {r.chunk_id for r in search_variants(chunks, docs, v, Config(top_k=6, search_mode="lexical")).collect()}
    assert {10, 21} <= got


def fused_by_hand(vectors, asked, scores, candidates, k):
    """Every candidate of every query, ranked in both lanes and fused."""
    out = []
    for q, v in asked.items():
        cosine = {c: round(min(1.0, max(0.0, float(np.dot(v, vectors[c]) / (np.linalg.norm(v) * np.linalg.norm(vectors[c]))))), 6) for c in candidates if v is not None and vectors.get(c) is not None}
        place_v = {c: i + 1 for i, c in enumerate(sorted(cosine, key=lambda c: (-cosine[c], c)))}
        place_x = {c: i + 1 for i, c in enumerate(sorted(candidates, key=lambda c: (-round(scores.get((q, c), 0), 6), c)))}
        fused = {c: float(Decimal(repr(((1 / (60 + place_v[c]) if c in place_v else 0) + 1 / (60 + place_x[c])) / (2 / 61))).quantize(Decimal("0.000001"), ROUND_HALF_UP)) for c in candidates}
        out += [(q, c, fused[c], i + 1) for i, c in enumerate(sorted(candidates, key=lambda c: (-fused[c], c))[:k])]
    return sorted(out)


@pytest.mark.parametrize("n,k,kind", [(700, 3, "long"), (300, 10, "string"), (5, 10, "long"), (0, 3, "long")])
def test_memory_hybrid_equals_all_pairs(spark, n, k, kind):
    r = random.Random(n + k)
    name = (lambda i: i) if kind == "long" else (lambda i: f"c{i}")
    candidates = [name(i) for i in range(n)]
    # few values: many equal scores; vectors without a candidate, candidates without a vector
    vectors = {name(i): None if i % 11 == 0 else [1.0, float(r.randrange(9)), float(r.randrange(3))] for i in range(n + 20) if i % 7}
    asked = {1: [1.0, 2.0, 0.0], 2: None, 3: [0.5, 0.0, 1.0], 4: [1.0, 1.0, 1.0]}
    # query 1 matches nearly all, 2 a third, 3 a few, 4 none
    scores = {(q, c): r.choice([0.0, 0.25, 0.5, 3.0]) for q, share in ((1, 0.95), (2, 0.3), (3, 0.02)) for c in candidates if r.random() < share}
    got = fusion.memory_hybrid(
        frame(spark, list(vectors.items()), f"chunk_id {kind}, embedding array<double>"),
        frame(spark, [(q,) for q in asked], "query_id long"),
        frame(spark, list(asked.items()) + [(99, [1.0, 0.0, 0.0])], "query_id long, embedding array<double>"),
        frame(spark, [(q, c, s) for (q, c), s in scores.items()], f"query_id long, chunk_id {kind}, score double"),
        frame(spark, [(c,) for c in candidates], f"chunk_id {kind}"),
        k,
    )
    have = sorted((x.query_id, x.chunk_id, x.score, x["rank"]) for x in got.collect())
    assert have == fused_by_hand(vectors, asked, scores, candidates, k)


def test_vector_places_in_batches(spark, monkeypatch):
    monkeypatch.setattr(vector, "PLACED", 2)
    c = frame(spark, [(i, [1.0, float(i % 13)]) for i in range(90)] + [(90, None), (91, [1.0])], "chunk_id long, embedding array<double>")
    q = frame(spark, [(i, [1.0, float(i)]) for i in range(5)] + [(5, None)], "query_id long, embedding array<double>")
    lane = {(x.query_id, x.chunk_id): x["rank"] for x in vector.batch_topk(c, q, 1000).collect()}
    wanted = frame(spark, [(a, b) for a in range(6) for b in (0, 12, 13, 47, 89, 90, 91)], "query_id long, chunk_id long")
    got = {(x.query_id, x.chunk_id): x.place for x in vector.places(c, q, wanted, block=7).collect()}
    assert got == {p: lane[p] for p in got} and len(got) == 25


def pool_rows(spark, queries, n):
    rows = [(q, c, f"q{q}", "x" * c, 1.0 - c / 100, c) for q in queries for c in range(1, n + 1)]
    return frame(spark, rows, "query_id long, chunk_id long, query string, text string, score double, rank int")


def test_model_scores_in_batches_and_a_failure_stays_with_its_query(spark, tmp_path):
    class Model:
        def __call__(self, pairs):
            (tmp_path / f"{len(pairs)}-{random.random()}").touch()
            if any(q == "q2" for q, _ in pairs):
                raise ValueError("no")
            return [float("nan") if len(t) == 3 else float(len(t) - 5) for _, t in pairs]

    r = pool_rows(spark, [1, 2, 3], 10).unionByName(pool_rows(spark, [4], 1)).repartition(1)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        out = rerank.applied(r, rerank.by_model(r, Model, 4, batch=8), 4).orderBy("query_id", "rank").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    got = {q: [(x.chunk_id, x.reranked, x.rerank_error) for x in out if x.query_id == q] for q in (1, 2, 3, 4)}
    assert got[1] == got[3] == [(c, True, None) for c in (10, 9, 8, 7)]
    assert got[2] == [(c, False, "no") for c in (1, 2, 3, 4)] and got[4] == [(1, False, None)]
    assert max(int(p.name.split("-")[0]) for p in tmp_path.iterdir()) == 8
    assert [round(x.score, 6) for x in out if x.query_id == 1][0] == round(1 / (1 + math.exp(-5)), 6)


def test_service_answers(spark, tmp_path):
    class Service:
        def __call__(self, query, texts, top_n):
            (tmp_path / f"{query}-{random.random()}").touch()
            if query == "q1":
                raise rerank.RerankError("HTTP 403", 403)
            if query == "q2":
                raise OSError("late")
            if query == "q3":
                return []
            return [(4, 2.0), (1, -1.0), (0, None), (99, 1.0), (4, 0.1), (-1, 0.5)]

    r = pool_rows(spark, [1, 2, 3, 4], 6).unionByName(frame(spark, [(5, 1, None, None, 0.5, 1)], "query_id long, chunk_id long, query string, text string, score double, rank int"))
    out = rerank.applied(r, rerank.by_service(r, Service, 3, attempts=2, base=0.001), 3).orderBy("query_id", "rank").collect()
    got = {q: [(x.chunk_id, x.score, x.reranked, x.rerank_error) for x in out if x.query_id == q] for q in range(1, 6)}
    # scores of 0 keep the order of before
    assert got[4] == [(5, 1.0, True, None), (1, 0.0, True, None), (2, 0.0, True, None)]
    assert [x[0] for x in got[1]] == [x[0] for x in got[2]] == [x[0] for x in got[3]] == [1, 2, 3]
    assert got[1][0][2:] == (False, "HTTP 403") and got[2][0][2:] == (False, "late") and got[3][0][2:] == (False, None)
    assert got[5] == [(1, 0.5, False, None)]
    calls = [p.name.split("-")[0] for p in tmp_path.iterdir()]
    # what lasts is not tried again, what may pass is
    assert {q: calls.count(q) for q in set(calls)} == {"q1": 1, "q2": 2, "q3": 1, "q4": 1}
    assert rerank.by_service(r.limit(0), Service, 3).count() == rerank.by_model(r.limit(0), Service, 3).count() == 0


def test_search_with_a_failing_reranker_keeps_hits(spark):
    class Service:
        def __call__(self, query, texts, top_n):
            if query.startswith("alpha"):
                raise OSError("down")
            return [(i, 0.9 - i / 10) for i in reversed(range(len(texts)))]

    chunks, docs = world(spark)
    q = frame(spark, [(1, "alpha document", [1.0, 0.0]), (2, "beta fox", [0.0, 1.0])], "query_id long, query string, embedding array<float>")
    plain = search(chunks, docs, q.where("query_id = 1"), Config(top_k=3)).orderBy("rank").collect()
    hits = search(chunks, docs, q, Config(top_k=3, similarity_threshold=0.85), scorer=rerank.service_scorer(Service)).orderBy("query_id", "rank").collect()
    # the failed query has its hits as before, with no threshold; of the other's the threshold leaves one
    assert [h.chunk_id for h in hits if h.query_id == 1] == [h.chunk_id for h in plain]
    assert [h.score for h in hits if h.query_id == 2] == [0.9]
