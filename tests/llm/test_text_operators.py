"""Packing, mixing, token counts, extraction, quality and language against plain versions and on odd input."""

import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from oracle import check
from pyspark.sql import functions as F

from stackwise.llm import common, extract, langid, mixing, packing, quality, queries, tokencount

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, source string, h string, n string, size string, score string, row string, id string"


def odd(spark):
    """Null, empty, blank, repeated and long texts; null sources and ids; columns whose names the operators use themselves."""
    rows = [(1, None, "a"), (2, "", "a"), (3, " \n\t ", "b"), (4, "hello world", None), (4, "hello world", None), (5, "x y " * 30_000, "b"), (6, "same text", "a"), (7, "same text", "c"), (None, "no id", "c"), (8, "tab\x1csep <|endoftext|> é́", "c")]
    return spark.createDataFrame([(*r, "h", "n", "z", "s", "r", "i") for r in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- packing


def check_packing(pieces, texts, window=2048):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    pieces = sorted(pieces, key=lambda p: (p.sequence_id, p.offset))
    at = None
    for p in pieces:
        assert p.length > 0 and p.offset + p.length <= window
        assert (at == (p.sequence_id, p.offset)) if at and at[0] == p.sequence_id else p.offset == 0
        if at and at[0] != p.sequence_id:
            assert p.sequence_id == at[0] + 1 and at[1] == window
        at = (p.sequence_id, p.offset + p.length)
    by = defaultdict(list)
    for p in pieces:
        by[p.doc_id].append(p)
    for doc_id, text in texts.items():
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [1], dtype="<u4")
        own = sorted(by.pop(doc_id), key=lambda p: (p.start, p.sequence_id))
        copies = sum(p.length for p in own) / len(ids)
        assert copies in (1, 2)
        assert all(p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes()) for p in own)
    assert not by


def test_packing_round_trip(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    pieces = packing.pack(df, WORDS, lane_tokens=20_000).collect()
    check_packing(pieces, {r.doc_id: r.text for r in df.collect()})


def test_packing_odd(spark):
    df = odd(spark)
    check_packing(packing.pack(df, WORDS).collect(), {r.doc_id: r.text for r in df.collect()})
    assert packing.pack(empty(spark), WORDS).count() == 0


def test_packing_keeps_the_mixture(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randint(20, 400), "big" if i % 10 else "small") for i in range(2000)]
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, source string"), WORDS, lane_tokens=60_000).collect()
    share = sum(len(t.split()) + 1 for _, t, s in rows if s == "small") / sum(len(t.split()) + 1 for _, t, _ in rows)
    # after any number of windows what was taken of a source is within a few documents of what is due
    taken = defaultdict(int)
    for p in pieces:
        taken[p.sequence_id] += p.length if p.doc_id % 10 == 0 else 0
    got = np.cumsum([taken[i] for i in range(max(taken) + 1)])
    assert np.abs(got - share * 2048 * np.arange(1, len(got) + 1)).max() < 3 * 400 + 2048 * share


def lane_loads(spark, rows, monkeypatch, parts, lane_tokens):
    """Pieces, and the tokens of each lane (by source) as they are dealt."""
    loads = []
    monkeypatch.setattr(packing, "PARTS", parts)
    monkeypatch.setattr(packing, "saved", lambda df, tag, keep=packing.saved: loads.append(keep(df, tag)) or loads[-1])
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, source string"), WORDS, lane_tokens=lane_tokens).collect()
    monkeypatch.undo()
    lanes = defaultdict(dict)
    for r in loads[-1].collect():
        lanes[r.lane][r.source] = r.tokens
    return pieces, lanes


@pytest.mark.parametrize("parts", [2, 8, 4096])
def test_lanes_have_the_mixture_with_few_parts_and_many(spark, monkeypatch, parts):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randint(20, 80), "big" if i % 5 else "small") for i in range(6000)]
    pieces, lanes = lane_loads(spark, rows, monkeypatch, parts, 15_000)
    check_packing(pieces, {i: t for i, t, _ in rows})
    assert len(lanes) == 21 and max(sum(x.values()) for x in lanes.values()) < 1.4 * 15_000
    assert all(0.12 < x["small"] / sum(x.values()) < 0.28 for x in lanes.values())


@pytest.mark.parametrize("hot", [(None, "the same text " * 10), (7, "the same text " * 10), (None, None)])
def test_rows_of_one_id_are_dealt_to_all_lanes(spark, monkeypatch, hot):
    rows = [(i, f"some words {i} " * 10, "a") for i in range(100, 2100)] + [(*hot, "a")] * 1000 + [(None, f"text {i} " * 10, "b") for i in range(500)]
    pieces, lanes = lane_loads(spark, rows, monkeypatch, 64, 4_000)
    assert sum(p.length for p in pieces) == sum(sum(x.values()) for x in lanes.values())
    assert max(sum(x.values()) for x in lanes.values()) < 1.5 * 4_000


def test_sources_of_one_document_are_dealt_to_all_lanes(spark, monkeypatch):
    rows = [(i, "w " * 50, f"host {i}") for i in range(1000)]
    _, lanes = lane_loads(spark, rows, monkeypatch, 4096, 5_000)
    assert max(sum(x.values()) for x in lanes.values()) < 2 * 5_000


def test_deficit_is_carried():
    import pyarrow as pa

    docs = pa.table({"doc_id": [1, 2, 3, 4], "source": ["a", "a", "b", "b"], "n": [4, 4, 4, 4], "wide": [False] * 4, "ids": [np.arange(4, dtype="<u2").tobytes()] * 4})
    state = lambda a, b: pa.table({"source": ["a", "b"], "before": [a, b], "lane_before": [80, 80], "share": [0.5, 0.5]})
    assert packing.deal(docs, state(80, 0), 8)["doc_id"].to_pylist()[:2] == [3, 4]  # a is ahead from earlier lanes
    assert packing.deal(docs, state(0, 80), 8)["doc_id"].to_pylist()[:2] == [1, 2]
    assert packing.deal(docs, state(40, 40), 8)["doc_id"].to_pylist() == [1, 3, 2, 4]


# --- mixing


def filled(sizes, weights=(5, 2, 1), most=3):
    """Targets by giving excess away again and again."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        t = {s: left * w[s] / sum(w[x] for x in rest) for s in rest}
        over = [s for s in rest if t[s] > most * sizes[s]]
        if not over:
            return capped | t
        capped |= {s: most * sizes[s] for s in over}


def plain_round_robin(queues, shares, window):
    """Tokens of each source in each window: every round each source earns its share of a window and sends documents while its credit lasts."""
    queues, credit, sent = {k: list(v) for k, v in queues.items()}, dict.fromkeys(shares, 0.0), []
    while any(queues.values()):
        for s in sorted(shares):
            credit[s] += shares[s] * window
            while queues[s] and queues[s][0] <= credit[s]:
                credit[s] -= queues[s][0]
                sent += [s] * queues[s].pop(0)
    return [{s: sent[i : i + window].count(s) for s in shares} for i in range(0, len(sent), window)]


@pytest.mark.parametrize("lane", [40_000, 10_000_000])
def test_packing_to_given_shares(spark, lane):
    """A source of a tenth of all tokens that is to be half of the mix is half of every window until it ends, and in none after it."""
    rng = random.Random(4)
    rows = [(i, "small" if i % 10 == 0 else "large", "word " * rng.randint(10, 40)) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), window=2048, shares=F.lit(0.5), lane_tokens=lane).collect()
    source = {r[0]: r[1] for r in rows}
    got: dict[int, dict] = {}
    for p in pieces:
        w = got.setdefault(p.sequence_id, {"small": 0, "large": 0})
        w[source[p.doc_id]] += p.length
    assert sum(sum(w.values()) for w in got.values()) == sum(len(r[2].split()) + 1 for r in rows)
    want = plain_round_robin({s: [len(r[2].split()) + 1 for r in rows if r[1] == s] for s in ("small", "large")}, {"small": 0.5, "large": 0.5}, 2048)
    ends = max(i for i, w in enumerate(want) if w["small"])
    # a document, and at a lane's edge the spread of a part
    for i in range(len(want) - 1):
        if i < ends - 2:
            assert abs(got[i]["small"] - want[i]["small"]) <= 2048 * 0.1, i
        if i > ends + 2:
            assert got[i]["small"] == 0, i


def test_packing_to_shares_of_many_sources(spark):
    rows = [(i, f"s{i % 7}", "word " * 30) for i in range(1400)] + [(9999, None, "word " * 500)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    weight = F.when(F.col("source") == "s0", 6).when(F.col("source").isNull(), 0).otherwise(1) / 12
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), window=512, shares=weight, lane_tokens=20_000).collect()
    assert sum(p.length for p in pieces) == 1400 * 31 + 501
    # documents of 31 tokens against quanta of 43: the proportions hold over some windows
    first = [p for p in pieces if p.sequence_id < 9]
    assert 0.45 <= sum(p.length for p in first if p.doc_id % 7 == 0) / sum(p.length for p in first) <= 0.55


def test_copies_are_made_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "COPIES", 10)
    entries = spark.createDataFrame([(1, "a", 3, 5000, 0), (2, "a", 4, 2, 15_000)], "id long, source string, size long, n long, begin long")
    out = mixing.copied(entries)
    tasks = out.where("id = 1").groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) >= 100 and sum(r["count"] for r in tasks) == 5000 and max(r["count"] for r in tasks) <= 500
    assert out.where("id = 1").select("begin").distinct().count() == 5000


def test_mixing_equals_sql(spark, sf):
    check(queries.QUERIES["op3_mix"](spark, sf), queries.ORACLES["op3_mix"], sf)


def test_mixing_targets(spark):
    rng = random.Random(5)
    sizes = {s: rng.choice([0, 1, 10, 1000, 50_000]) for s in [f"s{i:02}" for i in range(17)]} | {None: 77}
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(rows).collect()}
    want = filled(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)


def test_mixing_odd(spark):
    df = odd(spark)
    a, b = (sorted(map(tuple, mixing.mix(df.repartition(n)).select("doc_id", "source", "size", "source_size", "target", "taken").collect()), key=str) for n in (1, 3))
    assert a == b and len(a) == 10
    sizes = defaultdict(int)
    for _, source, size, _, _, _ in a:
        sizes[source] += size
    want = filled(sizes)
    taken = defaultdict(int)
    for _, source, size, source_size, target, t in a:
        assert source_size == sizes[source] and abs(target - want[source]) < 1e-6 and 0 <= t <= 3 * size
        taken[source] += t
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    assert mixing.mix(empty(spark)).count() == 0
    assert mixing.mixed_documents(empty(spark)).count() == 0


def test_mixed_documents(spark):
    rows = [(i, " ".join(f"w{i}_{k}" for k in range(10 + i)), "s%d" % (i % 3)) for i in range(30)] + [(99, None, "s0")]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, source string, at long")
    plan = {r.doc_id: r for r in mixing.mix(df).collect()}
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    got = defaultdict(int)
    for r in out.collect():
        got[r.doc_id] += len(r.text.split())
    assert got == {k: v.taken for k, v in plan.items() if v.taken}


def test_mixed_documents_meet_the_targets_with_repeated_ids(spark):
    rows = [(i % 7 if i % 3 else None, " ".join(f"w{i % 50}_{k}" for k in range(20)), "s%d" % (i % 4), i) for i in range(400)] + [(5, "all the same words", "s0", i) for i in range(150)] + [(None, "no id here", None, 1)] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, at long")
    want = defaultdict(int)
    for r in mixing.mix(df).collect():
        want[r.source] += r.taken
    got = defaultdict(int)
    for r in mixing.mixed_documents(df).collect():
        got[r.source] += len(r.text.split())
    assert got == {k: v for k, v in want.items() if v}
    sizes = defaultdict(int)
    for _, text, source, _ in rows:
        sizes[source] += len(text.split())
    target = filled(sizes)
    assert all(abs(want[s] - target[s]) <= 1 for s in sizes)


def test_an_id_of_a_third_of_all_rows_is_one_entry(spark, monkeypatch):
    rows = [(i, "some words " * (i % 5 + 1), "a") for i in range(100, 700)] + [(None, "x y z", "a")] * 150 + [(7, "u v", "a")] * 150
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    entries = mixing.queued(mixing.sized(df, "doc_id", "source", "text"), mixing.WEIGHTS, 3, mixing.ramp)
    assert entries.count() == 602 and entries.groupBy("id").count().agg(F.max("count")).first()[0] == 1
    monkeypatch.setattr(mixing, "COPIES", 40)  # the copies of an entry are made in parts
    out = mixing.mix(df).collect()
    assert len(out) == 900 and sum(r.taken for r in out) == sum(r.size for r in out)
    assert sum(r.size for r in out) == sum(len(t.split()) for _, t, _ in rows)


def test_schedule_is_inverted(spark):
    t = spark.createDataFrame([("a", 100, 5, 100.0), ("b", 50, 1, 20.0)], "source string, source_size long, weight long, target double")
    d = mixing.with_demand(mixing.ramp(t))
    at = d.select("source", F.explode(F.array(*[F.lit(float(x)) for x in range(0, 20, 3)])).alias("c"), "segments", "scale").withColumn("t", mixing.position(F.col("segments"), F.col("scale"), F.col("c"))).collect()
    for r in at:
        # the demand at the position, integrated by steps, is the word it was asked for
        x = np.linspace(0, r.t, 20_001)
        share = np.interp(x, [r.segments[0].t0] + [s.t1 for s in r.segments], [r.segments[0].a] + [s.b for s in r.segments])
        assert abs(np.trapezoid(share, x) * r.scale - r.c) < 1e-4


# --- token counts


def test_token_counts(spark, sf):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    texts += ["", " ", "  ", "a  b", "\n\n", " a\n b ", "<s>x</s><unk>", "▁a ▁▁b", "日本語テキスト", "😀\x00\t", "x" * 4000, " " * 300, "<0x0A>", "aaaaaaaa bbbb", "İßſ\r\n"]
    rng = random.Random(2)
    texts += ["".join(rng.choice("ab ▁\né😀theTHE.,") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    c = tokencount.counter(PIECES)
    assert [c.count(t) for t in texts] == [len(x) for x in sp.encode(texts)]


def test_token_counts_odd(spark):
    got = tokencount.count_tokens(odd(spark), PIECES)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    by = {r.doc_id: r for r in got.collect()}
    assert got.count() == 10 and (by[1].n_bytes, by[1].n_tokens) == (by[2].n_bytes, by[2].n_tokens) == (0, 0) and by[5].over_limit and not by[4].over_limit
    assert tokencount.count_tokens(empty(spark), PIECES).count() == 0


# --- extraction


@pytest.mark.parametrize(
    "html,text",
    [
        ("", ""),
        ("<p>", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<div class='Top-Menu'>m</div><p>a <b>b</b>\n c</p>", "a b c"),
        ("<body><h1>T</h1><p>one<p>two &lt;x&gt;</body>", "T\none\ntwo <x>"),
        ("<header>h</header><article><header><h1>T</h1></header><p>x</p><aside>s</aside></article><footer>f</footer>", "T\nx"),
        ("<nav>n</nav><main><section><p>a b c</p></section><section><p>d</p></section></main><form>f<input></form>", "a b c\nd"),
        ("<article><p>text</p></article><div id='comments'><article class='comment'>long long long reader comment</article></div>", "text"),
        ("<script>var x='</p><article>no</article>';</script><article>yes<style>p{}</style></article>", "yes"),
        ("<article>a<br>b<ul><li>c<li>d</ul></article>", "a\nb\nc\nd"),
        ("<article><!-- no --><p>a < b<p title='>'>c</p></article>", "a < b\nc"),
        ("<div role=banner>x</div><div hidden>y</div><div class=cookie-notice>z</div><p>w</p>", "w"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
        ("<div>" * 3000 + "deep" + "</div>" * 10, "deep"),
        ("<article><p>&#x41;&#66;&eacute;&nbsp;z</article><p unfinished", "ABé z"),
    ],
)
def test_main_text(html, text):
    assert extract.main_text(html) == text


def test_density_without_an_article():
    menu = "<div>" + "".join(f"<a href='/{i}'>link {i}</a>" for i in range(30)) + "</div>"
    body = "<div>" + "".join(f"<p>{'words of the story ' * 20}</p>" for _ in range(5)) + "</div>"
    assert extract.main_text(f"<body>{menu}{body}<div><a>more</a></div></body>") == "\n".join([("words of the story " * 20).strip()] * 5)


def test_extract_odd(spark):
    df = spark.createDataFrame([(1, "u", None, "t", "r"), (2, None, "<p>a</p>", "t", "r"), (2, None, "<p>a</p>", "t", "r")], "page_id long, url string, html string, text string, row string")
    out = extract.extract(df)
    assert out.columns == ["page_id", "url", "row", "text", "n_chars"]
    assert sorted((r.page_id, r.text, r.n_chars) for r in out.collect()) == [(1, "", 0), (2, "a", 1), (2, "a", 1)]
    assert extract.extract(df.where("false")).count() == 0


def articles(page):
    """The text of the given pages' articles, by a regular expression."""
    import html
    import re

    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = re.split(r"<(?:/?(?:p|h1)|br)>", inner)
    texts = (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", "", x))).strip() for x in parts)
    return "\n".join(t for t in texts if t)


def pages_of(folder):
    return [h for (h,) in duckdb.sql(f"SELECT html FROM '{folder}/pages.parquet' WHERE html LIKE '%<article>%</article>%' ORDER BY page_id").fetchall()]


@pytest.mark.parametrize("words,least", [(extract.WORDS, 1.0), (frozenset(), 0.95)])
def test_density_finds_the_articles_without_their_element(monkeypatch, words, least):
    """Without article elements the text is the same, and nearly so without any names of boilerplate; without densities it is not."""
    monkeypatch.setattr(extract, "WORDS", words)
    pages = pages_of("/root/testdata/sf0.01")
    want = [articles(p) for p in pages]
    renamed = [p.replace("<article>", "<div>").replace("</article>", "</div>") for p in pages]
    assert np.mean([extract.main_text(p) == w for p, w in zip(renamed, want)]) >= least
    monkeypatch.setattr(extract, "densities", lambda kept, body: None)
    assert np.mean([extract.main_text(p) == w for p, w in zip(renamed, want)]) < 0.1


def test_extract_leaves_boilerplate_out():
    story = "".join(f"<p>{'Some words of the story that go on. ' * 5}{i}</p>" for i in range(4)) + "<p>The end.</p>"
    want = [f"{'Some words of the story that go on. ' * 5}{i}" for i in range(4)] + ["The end."]
    menu = "<ul>" + "".join(f"<li><a href='/{i}'>Topic {i}</a></li>" for i in range(6)) + "</ul>"
    comments = "<div class='comments'>" + "<div class='comment'><p>I do not agree with this at all, as I said before.</p></div>" * 9 + "</div>"
    around = [f"<div class='header'>The site {menu}</div>", "<div id='cookie-notice'><p>We use cookies for your best experience of this site.</p><button>Accept</button></div>", f"<div class='sidebar'><h3>More</h3>{menu}</div>", "<form><p>Sign up for news</p><input name=q></form>", f"<div class='footer'><p>All rights are reserved by the owners of the site.</p>{menu}</div>"]
    for page in (
        f"<body>{around[0]}{around[1]}<article>{story}</article>{around[2]}{around[3]}{around[4]}</body>",
        f"<body>{around[0]}<div class='post'>{story}{comments}</div>{around[2]}{around[1]}{around[4]}</body>",
        f"<body>{around[0]}<article>{story}<section class='ads'><p>Buy this now at a good price.</p></section>{comments}</article></body>",
        f"<body><div class='page with-sidebar'>{around[0]}<main>{story}</main>{around[2]}</div>{comments}{around[4]}</body>",
        f"<body><table><tr><td>{menu}</td><td>{story}</td></tr></table><div role='contentinfo'>Us</div><p hidden>Not seen</p></body>",
    ):
        assert extract.main_text(page).split("\n") == want, page


def test_extract_equals_the_articles(spark, sf):
    import html
    import re

    for r in extract.extract(spark.read.parquet(f"{sf}/pages.parquet").withColumn("raw", F.col("html"))).collect():
        inner = re.search(r"<article[^>]*>(.*?)(?:</article>|<footer|$)", r.raw, re.S)[1]
        inner = re.sub(r"<[a-zA-Z/!][^>]*>", "", re.sub(r"</?(?:p|h1|br)\b[^>]*>", "\n", inner))
        want = [re.sub(r"\s+", " ", html.unescape(x)).strip() for x in inner.split("\n")]
        assert r.text == "\n".join(x for x in want if x)


# --- quality


def sampled(columns, most=3000):
    """Rows of the larger test table, as it has enough labels."""
    return duckdb.sql(f"SELECT {columns} FROM '/root/testdata/sf0.1/documents.parquet' LEFT JOIN '/root/testdata/sf0.1/labels.parquet' USING (doc_id) ORDER BY hash(doc_id) LIMIT {most}").fetchall()


def test_quality_held_out(spark):
    rows = [r for r in sampled("doc_id, text, quality", 6000) if r[2] is not None]
    docs = spark.createDataFrame([(a, b) for a, b, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(a, c) for a, _, c in rows], "doc_id long, quality int")
    out = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    truth = {a: c for a, _, c in rows}
    held = [r for r in out.values() if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out.values())
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) >= 0.97
    assert np.mean([r.predicted for r in held if truth[r.doc_id] == 1]) >= 0.99
    # labels of the held fold do not change a score
    flipped = labels.withColumn("quality", F.when(quality.in_fold(F.col("doc_id"), 3, 1), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in quality.classify(docs, flipped).collect()}
    assert again == {k: r.score for k, r in out.items()}


def test_quality_odd(spark):
    labels = spark.createDataFrame([(4, 1), (4, 1), (6, 0), (77, 1), (None, 0), (7, None)], "doc_id long, quality int")
    out = quality.classify(odd(spark), labels)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = out.collect()
    assert len(rows) == 10 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1, 2, 3)}) == 1
    none = quality.classify(odd(spark), labels.where("false")).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.classify(empty(spark), labels).count() == 0
    assert quality.score(odd(spark), quality.train([], [], **quality.MODEL)).columns == [c for c in odd(spark).columns if c != "score"] + ["score"]


def test_long_texts_are_scored_by_pieces(monkeypatch):
    text = " ".join(f"word{i % 97} other{i % 89}" for i in range(4000))
    model = quality.train([text, "junk junk !!! 123"] * 3, [1, 0] * 3, **quality.MODEL)
    languages = langid.learn({"a": [text], "b": ["junk junk !!! 123"]})
    whole, mixture = model.scores([text, "short", text]), languages.mixtures([text])
    for module in (quality, langid):
        monkeypatch.setattr(module, "pieces_of", lambda t: common.pieces_of(t, 1000))
    monkeypatch.setattr(langid, "PIECE_CHARS", 1000)
    monkeypatch.setattr(quality, "batches_of_text", lambda texts: common.batches_of_text(texts, 1000))
    assert np.allclose(model.scores([text, "short", text]), whole, atol=0.02)
    assert np.allclose(languages.mixtures([text]), mixture, atol=1e-3)
    assert "".join(common.pieces_of(text, 1000)) == text and max(map(len, common.pieces_of(text, 1000))) <= 1000
    assert list(common.pieces_of("x" * 2500, 1000)) == ["x" * 1000, "x" * 1000, "x" * 500]


# --- languages


@pytest.mark.parametrize("text", ["½ ² Ⅷ ①", "12 _ -- !", "", " \n"])
def test_no_letter_is_no_language(text):
    assert not langid.has_letter(text) and langid.has_letter(text + "ж") and langid.has_letter(text + "語")


def test_language_held_out(spark):
    rows = sampled("doc_id, text, lang", 2500)
    out = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    truth = {a: c for a, _, c in rows}
    held = [r for r in out if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) >= 0.97


def test_three_hundred_languages(spark):
    """Every language of the table is learned, however rare."""
    rng = random.Random(6)
    syllables = [a + b + c for a in "bcdfghklmnprstvz" for b in "aeiou" for c in "lnrst"]
    own = [rng.sample(syllables, 6) for _ in range(300)]
    text = lambda k: " ".join(rng.choice(own[k]) + rng.choice(own[k]) for _ in range(60))
    rows = [(i, text(i % 300), f"l{i % 300:03d}") for i in range(900)] + [(10_000 + i, text(0), "l000") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert len(model.names) == 300
    found = langid.predict(docs, model, ["doc_id", "lang"])
    assert found.where("lang = lang_pred").count() >= 0.95 * len(rows)


def plain_mixture(text, model):
    """The proportions of one text by loops over its words: expectation and maximisation, then nested sets by penalised likelihood."""
    logs, _ = model.likelihoods([text])
    like = np.exp(logs - logs.max(1, keepdims=True)).astype(float)
    n, size = like.shape

    def run(shares, rounds):
        for _ in range(rounds):
            total = np.zeros(size)
            for w in range(n):
                r = like[w] * shares
                total += r / r.sum()
            shares = total / n
        return shares, sum(np.log((like[w] * shares).sum()) for w in range(n))

    shares, _ = run(np.full(size, 1 / size), model.rounds)
    order = sorted(range(size), key=lambda j: (-shares[j], j))
    best = None
    for m in range(1, max(1, int((shares >= 0.005).sum())) + 1):
        first = np.array([shares[j] if j in order[:m] else 0.0 for j in range(size)])
        s, ll = run(first / first.sum(), 0 if m == 1 else model.rounds // 2)
        value = ll - model.penalty * m * np.log(n + 1)
        if best is None or value > best[0]:
            best = value, s
    return best[1]


def test_mixtures_equal_plain_loops(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.fit(docs)
    texts = [r.text for r in docs.orderBy("doc_id").limit(25).collect()]
    texts = [t[:1500] for t in texts if t and langid.has_letter(t)]
    texts += [texts[i][:400] + " " + texts[-i - 1][:400] for i in range(5)]
    for t, row in zip(texts, model.mixtures(texts)):
        assert np.allclose(row, plain_mixture(t, model), atol=2e-3)


def test_mixtures():
    rows = sampled("lang, text", 1500)
    by = defaultdict(list)
    for lang, text in rows:
        by[lang].append(text)
    m = langid.learn({k: v[:100] for k, v in by.items()})
    clean = {k: " ".join(v[-20:])[:6000].rpartition(" ")[0] for k, v in by.items()}
    one, two = m.mixtures([clean["de"], clean["de"] + " " + clean["fr"]])
    assert m.names[one.argmax()] == "de" and one.max() > 0.95
    assert {m.names[j] for j in np.argsort(-two)[:2]} == {"de", "fr"} and 0.35 < two.max() < 0.65


def test_language_odd(spark):
    df = odd(spark).withColumn("lang", F.when(F.col("doc_id") == 5, "xx").when(F.col("doc_id") == 4, "yy"))
    out = langid.identify(df)
    assert out.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    rows = out.collect()
    assert len(rows) == 10 and all(0 <= r.score <= 1 for r in rows)
    assert {r.lang_pred for r in rows if r.doc_id in (1, 2, 3)} == {"und"}
    assert {r.lang_pred for r in langid.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify(df.where("false")).count() == 0


def test_sections_without_article_or_main():
    para = lambda k: f"<p>{f'word{k} ' * 30}</p>"
    one, two = ("<section>" + "".join(map(para, range(a, a + 5))) + "</section>" for a in (10, 20))
    links = "<ul>" + "".join(f"<li><a href='/{i}'>Other story {i}</a></li>" for i in range(8)) + "</ul>"
    for page in (f"<body>{one}{two}</body>", f"<body><div><h1>The title</h1>{one}{two}</div></body>", f"<body>{links}<div><h1>The title</h1>{one}<h2>Part</h2><p>Short.</p>{two}</div>{links}</body>", f"<body><div>Loose <b>text</b> first{one}{two}</div></body>"):
        text = extract.main_text(page)
        assert all(f"word{k} " in text for k in (*range(10, 15), *range(20, 25))), page
        assert "Other story" not in text
        for wanted in ("The title", "Part", "Short.", "Loose <b>text</b> first"):
            assert wanted not in page or wanted.replace("<b>", "").replace("</b>", "") in text
