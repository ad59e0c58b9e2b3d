import math

import pytest
from pyspark.sql import functions as F

from stackwise import config
from stackwise.functions import text as T, vectors as V


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text,n", [("", 1), ("twelve chars", 3), ("雨水河流", 3), ("Mountain 山川湖 lake", 6)])
def test_est_tokens(spark, text, n):
    assert value(spark, T.est_tokens(F.lit(text))) == n


def test_char_budget(spark):
    size, overlap = T.char_budget(F.lit(("word " * 1000).strip()), 500, 50)
    assert (value(spark, size), value(spark, overlap)) == (2000, 200)


@pytest.mark.parametrize("text,tokens", [("Knowledge 知识库 base a", ["knowledge", "base", "知识", "识库"]), ("élan vital 库", ["lan", "vital", "库"])])
def test_tok_bigram(spark, text, tokens):
    assert value(spark, T.tok_bigram(F.lit(text))) == tokens


def test_match_and_short_terms(spark):
    assert value(spark, T.tok_match_terms(F.lit("报销流程 fox fox Fox ab 中文abc"))) == ["fox", "Fox", "abc", "报销流", "销流程"]
    assert value(spark, T.tok_short_terms(F.lit("年假 ab ab 中 abc"))) == ["年假", "ab", "中"]
    assert value(spark, T.tok_match_terms(F.lit("!!! ### （（（"))) == []


def test_normalize(spark):
    assert value(spark, T.normalize(F.lit(" a\r\nb\r\r\n\n\nc \t"))) == "a\nb\n\nc"


def test_like(spark):
    assert value(spark, T.like_contains(F.lit("50% OFF_x"), F.lit("% off_"))) is True
    assert value(spark, T.like_contains(F.lit("É"), F.lit("é"))) is False


def test_entities(spark):
    text = "&#65;&#x42;&#X1F600; &amp;lt; &LT; &nope; &#xD800; &#1114112; &copy;"
    assert value(spark, T.entities(F.lit(text))) == "AB😀 &lt; < &nope; � � ©"


def test_html(spark):
    html = "<html><head><title> A &amp; B </title></head><body><!-- x --><script>var a='<p>'</script><p>Rain over <b>the hills</b></p><div>Then sun</div></body></html>"
    assert value(spark, T.html_text(F.lit(html))) == "Rain over the hills\nThen sun"
    assert value(spark, T.html_title(F.lit(html))) == "A & B"


@pytest.mark.parametrize("url,ok", [("https://a.org/x", True), ("http://127.0.0.1", False), ("http://[::1]/", False), ("http://u@10.0.0.1:8/x", False), ("http://172.32.0.1", True), ("ftp://a.org", False), ("http://localhost:9", False), ("nonsense", False)])
def test_url_allowed(spark, url, ok):
    assert value(spark, T.url_allowed(F.lit(url))) is ok


def test_ocr(spark):
    assert value(spark, T.ocr_despaced(F.lit("知 识 库\n中 a b"))) == "知识库\n中 a b"


def test_read_slice(spark):
    text, more = T.read_slice(F.lit("the quick brown"), 4, 9)
    assert value(spark, text) == "quick" and value(spark, more)
    text, more = T.read_slice(F.lit("abc"), 7, None)
    assert value(spark, text) == "" and not value(spark, more)


def test_citation(spark):
    assert value(spark, T.citation(F.lit("t"), F.lit("h"), F.lit("b"), F.lit("x\ny"))) == "> x\n> y\n>\n> — t / h（知识库 b）"


def test_vectors(spark):
    a = lambda *x: F.array(*map(F.lit, map(float, x)))
    assert value(spark, V.cosine(a(1, 0), a(-1, 0))) == 0
    assert value(spark, V.cosine(a(1, 0), a(2, 0))) == 1
    assert value(spark, V.cosine(a(0, 0), a(1, 0))) == 0
    assert value(spark, V.cosine(a(1, 0), a(1, 0, 0))) == 0
    assert value(spark, V.normalized(a(0, 0))) == [0, 0]
    assert math.isclose(value(spark, V.norm(V.normalized(a(3, 4)))), 1)


def test_config():
    c = config.resolve({"chunk_size": 10, "top_k": 500, "search_mode": "odd", "chunk_overlap": 9999}, {"chunk_size": float("nan"), "rrf_vector_weight": 9})
    assert (c.chunk_size, c.top_k, c.search_mode, c.chunk_overlap, c.rrf_vector_weight) == (1024, 50, "auto", 1023, 5.0)
    assert config.merge_base({"a": 1, "b": "x"}, {"b": " ", "c": 2, "a": None}) == {"a": 1, "c": 2}
    assert config.compact({"a": "", "b": None, "c": 0}) == {"c": 0}
    assert config.clamp_int(3.9, 0, 5, 1) == 3 and config.clamp_int("3", 0, 5, 1) == 1
    assert [config.pooling(x) for x in ("Qwen3-Embedding", "bge-small", "e5")] == ["last_token", "cls", "mean"]
    assert config.Config(embedding_provider="local", embedding_model="m").model_tag == "local:m"
