import io
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from stackwise.operators import catalog, chunking as C, docops, evaluate, ingest
from stackwise.sources import files, samples
from stackwise.sources.html import html_markdown
from stackwise.streaming import ingest as stream


# --- chunking


def texts(pieces):
    return [t for t, _ in pieces]


def test_chunk_cases():
    assert C.chunk("", 800, 100) == []
    assert C.chunk("hello world", 800, 100) == [("hello world", "")]
    assert texts(C.chunk("one\n\ntwo\n\nthree", 800, 100)) == ["one", "two", "three"]
    assert C.chunk("# Intro\na\n## Methods\nb", 800, 100) == [("a", "Intro"), ("b", "Intro > Methods")]
    assert C.chunk("# Intro\n\n### Deep\nx", 800, 100) == [("x", "Intro > Deep")]
    assert texts(C.chunk("```\na\n\n# b\n```", 800, 100)) == ["```\na\n\n# b\n```"]
    assert texts(C.chunk("~~~~\na\n~~~\nb\n~~~~\n\nafter", 800, 100)) == ["~~~~\na\n~~~\nb\n~~~~", "after"]
    assert texts(C.chunk("one|cut|two two|cut|three", 800, 100, smart=False, separator="|cut|")) == ["one", "two two", "three"]


def test_fences():
    # what comes before a fence is a block of its own, and only its bare mark closes it
    assert texts(C.chunk("para\n```\ncode\n```\nafter", 800, 100)) == ["para", "```\ncode\n```\nafter"]
    assert texts(C.chunk("```\na\n```python\n\nb\n```", 800, 100)) == ["```\na\n```python\n\nb\n```"]
    text = "# Tools\nhow to run it\n\n```sh\n# a comment\n\nmake all\n\nmake test\n\n```\nand what it prints"
    assert sum("```" in t for t in texts(C.chunk(text, 800, 100))) == 1
    assert len(C.semantic_segments("a step\n\n```\nx = 1\n\ny = 2\n```\n\nits outcome")) == 3


def test_merged_vectors_are_weighed_by_what_is_embedded():
    x, y = [1.0, 0.0], [0.6, 0.8]
    out = C.semantic_merge([("a" * 10, "h"), ("b" * 30, ""), ("c" * 20, "")], [x, None, y], 1000, 0.5)
    mean = (10 * np.array(x) + 20 * np.array(y)) / 30
    assert len(out) == 1 and out[0][1] == "h" and np.allclose(out[0][2], mean / np.linalg.norm(mean))
    # a chunk whose first segment has no vector has none, and joins by size alone
    assert [v for *_, v in C.semantic_merge([("a", ""), ("b", ""), ("c", "")], [None, x, [0.0, 1.0]], 1000, 0.9)] == [None]


def test_windows():
    text = ("word " * 1000).strip()
    out = texts(C.chunk(text, 500, 50))
    assert len(out) > 1 and all(len(t) <= 2000 for t in out)
    assert all(t in text for t in out)
    # a heading beats a line end in the window's reach, and the cut leaves it to the next piece
    block = "x" * 85 + "\n# h " + "y" * 5 + "\n" + "z" * 100
    assert C.best_cut(block, 78, 100) == 85
    assert C.best_cut("a" * 50 + "。" + "b" * 60, 40, 60) == 51


def test_refine():
    text = "rain" * 10 + "。" + "snow" * 10 + "。" + "hail" * 10
    out = C.refine([(text, "h")], 25, lambda t: len(t) // 2)
    assert "".join(texts(out)) == text and len(out) == 3 and {h for _, h in out} == {"h"}
    assert C.refine([("x" * 200, "")], 10) == [("x" * 200, "")]
    assert C.refine([(text, "")], 0) == [(text, "")]


def test_semantic():
    seg = C.semantic_segments("# h\n\np1\n\np2\n\n## s\nq")
    assert texts(seg) == ["p1", "p2", "q"]
    v = [1.0, 0.0, 0.0]
    out = C.semantic_merge([("a" * 100, ""), ("b" * 100, ""), ("c" * 100, ""), ("d" * 200, "")], [v] * 4, 60)
    assert [len(t) for t, _, _ in out] == [201, 100 + 0, 200] or [len(t) for t, _, _ in out][0] == 201
    out = C.semantic_merge([("a", ""), ("b", ""), ("c", "")], [[1, 0, 0], [0, 1, 0], [0.1, 0.9, 0]], 100, 0.5)
    assert [t for t, _, _ in out] == ["a", "b\nc"]
    assert [x[2] for x in C.semantic_merge([("a" * 200, ""), ("b" * 200, "")], [None, None], 20)] == [None, None]


def test_with_chunks(spark):
    d = spark.createDataFrame([("b", "d1", "guide", "# Intro\nx\n## Methods\ny"), ("b", "d2", "none", None)], "base_id string, doc_id string, title string, raw_text string")
    rows = C.finished(C.with_chunks(d), "m:1").orderBy("idx").collect()
    assert [(r.idx, r.text, r.context, r.search_text) for r in rows] == [(0, "x", "guide > Intro", "guide > Intro\nx"), (1, "y", "guide > Intro > Methods", "guide > Intro > Methods\ny")]


# --- catalogue


def nodes(spark):
    rows = [("root", None, "R", "directory"), ("mid", "root", "M", "directory"), ("leaf", "mid", "L", "file"), ("top", None, "T", "file")]
    return spark.createDataFrame(rows, "doc_id string, parent_directory_id string, title string, source_type string")


def test_tree(spark):
    t = nodes(spark)
    assert [(r.doc_id, r.depth) for r in catalog.outline(t).orderBy("position").collect()] == [("root", 0), ("mid", 1), ("leaf", 2), ("top", 0)]
    pick = spark.createDataFrame([("root",), ("leaf",), ("top",)], "doc_id string")
    assert {r.doc_id for r in catalog.outermost(t, pick).collect()} == {"root", "top"}
    assert {r.doc_id for r in catalog.subtree(t, pick).collect()} == {"root", "mid", "leaf", "top"}
    ring = spark.createDataFrame([("a", "b", "x", "directory"), ("b", "a", "y", "directory")], t.schema)
    assert catalog.subtree(ring, spark.createDataFrame([("a",)], "doc_id string")).count() == 2


def test_deep_trees(spark):
    rows = [(f"d{i}", f"d{i - 1}" if i else None, f"t{i}", "directory") for i in range(300)] + [("ring1", "ring2", "x", "directory"), ("ring2", "ring1", "y", "directory"), ("under", "ring1", "z", "file"), ("self", "self", "s", "directory")]
    t = spark.createDataFrame(rows, "doc_id string, parent_directory_id string, title string, source_type string")
    got = catalog.outline(t).orderBy("position").collect()
    assert [(r.doc_id, r.depth, r.position) for r in got] == [(f"d{i}", i, i + 1) for i in range(300)]
    pick = lambda *ids: spark.createDataFrame([(x,) for x in ids], "doc_id string")
    assert catalog.subtree(t, pick("d200")).count() == 100
    assert {r.doc_id for r in catalog.subtree(t, pick("ring2", "d299")).collect()} == {"ring1", "ring2", "under", "d299"}
    assert {r.doc_id for r in catalog.outermost(t, pick("d7", "d250", "under")).collect()} == {"d7", "under"}
    assert catalog.importing_folders(t, pick("d250")).count() == 250
    assert {r.doc_id for r in catalog.importing_folders(t, pick("under")).collect()} == {"ring1", "ring2"}


def test_holders_equal_all_pairs(spark):
    words = "ab cd ef longword another x".split()
    rng = np.random.default_rng(3)
    docs = [(i, " ".join(rng.choice(words, rng.integers(0, 30)))) for i in range(60)] + [(99, None), (98, "ab\tcd\nef")]
    passages = [(i, " ".join(rng.choice(words, n))) for i, n in enumerate([1, 2, 3, 3, 4, 5, 3, 4])] + [(50, ""), (51, None), (52, "b cd e"), (53, " ab ")]
    got = evaluate.holders(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(passages, "item_id long, passage string"))
    want = [(d, p) for d, t in docs for p, x in passages if t is not None and x is not None and x in t]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_scope_and_recovery(spark):
    bases = spark.createDataFrame([("a",), ("b",)], "base_id string")
    assert {r.base_id for r in catalog.enabled(bases, ["ghost"]).collect()} == {"a", "b"}
    assert {r.base_id for r in catalog.enabled(bases, ["ghost", "b"]).collect()} == {"b"}
    assert catalog.scope(bases, []).count() == 0
    with pytest.raises(ValueError):
        catalog.by_documents(bases, list(range(501)), 500)
    d = spark.createDataFrame([("partial", True, None, None, None, "text", 1, None), ("raw", True, "p", None, None, "file", 1, None), ("pure", True, None, None, None, "file", 1, None), ("done", False, None, None, None, "file", 1, None)], "doc_id string, incomplete boolean, raw_file_path string, raw_text string, url string, source_type string, created_at long, updated_at long")
    c = spark.createDataFrame([("partial", 1)], "doc_id string, idx int")
    assert {r.doc_id: r.action for r in catalog.recovered(d, c, 10).collect()} == {"partial": "resume", "raw": "resume", "pure": "remove", "done": "keep"}


# --- documents


def test_grep(spark):
    d = spark.createDataFrame([(1, "The cat\nsat on the mat"), (2, "none"), (3, None)], "doc_id long, raw_text string")
    got = docops.grep(d, "the").orderBy("n").collect()
    assert [(r.n, r.line, r.char_start, r.char_end, r.match, r.total_matches) for r in got] == [(1, 1, 0, 3, "The", 2), (2, 2, 15, 18, "the", 2)]
    assert docops.grep(d, "x*").count() == 0
    assert docops.grep(d, "THE", ignore_case=False).count() == 0
    long = spark.createDataFrame([(1, "\n".join(f"line {i}" for i in range(100)))], d.schema)
    assert docops.grep(long, "line 99").first().char_start == sum(len(f"line {i}") + 1 for i in range(99))


def test_evaluation(spark):
    hits = spark.createDataFrame([(1, 1, "x"), (1, 2, "doc-a"), (2, 1, "y")], "question_id long, rank int, title string")
    e = spark.createDataFrame([(1, ["doc-a", "doc-b"]), (2, ["z"]), (3, [])], "question_id long, expect array<string>")
    s = evaluate.scores(evaluate.judged(hits, e)).first()
    assert (round(s.hit_at_k, 6), round(s.recall_at_k, 6), round(s.mrr, 6), s.questions) == (round(1 / 3, 6), round(1 / 3, 6), round(0.5 / 3, 6), 3)
    g = spark.createDataFrame([(1, "The Cat sat. On mats!Tiny? x"), (2, None)], "question_id long, golden string")
    h = spark.createDataFrame([(1, 1, "the cat sat. on", "mats")], "question_id long, rank int, text string, sibling_context string")
    assert [(r.question_id, round(r.recall, 6)) for r in evaluate.context_recall(g, h).collect()] == [(1, round(1 / 3, 6))]


# --- ingest


def test_conflict_policies(spark):
    stored = spark.createDataFrame([("b", "n.md"), ("b", "n_1.md"), ("b", "plain")], "base_id string, file_name string")
    new = spark.createDataFrame([("b", "n.md", 1), ("b", "n.md", 2), ("b", "free.md", 3), ("b", "plain", 4)], "base_id string, file_name string, seq long")
    names = {r.seq: (r.action, r.new_name) for r in ingest.resolved(new, stored, "rename").collect()}
    assert names == {1: ("rename", "n_2.md"), 2: ("rename", "n_3.md"), 3: ("add", "free.md"), 4: ("rename", "plain_1")}
    assert {r.seq: r.action for r in ingest.resolved(new, stored, "keep").collect()} == {1: "skip", 2: "skip", 3: "add", 4: "skip"}
    assert {r.file_name for r in ingest.batch_conflicts(new, stored).collect()} == {"n.md", "plain"}


def test_renames_take_the_free_numbers(spark):
    rng = random.Random(2)
    names = ["a.md", "a_1.md", "a_3.md", "a_4.md", "a_10.md", "a_007.md", "a_99999999999999999999.md", "b", "b_2", ".md", "a_1_2.md"]
    stored = [(rng.choice("xy"), n) for n in names for _ in range(1)] + [("x", "a.md"), ("y", "a.md")]
    new = [(rng.choice("xy"), rng.choice(names), i) for i in range(120)]
    got = {r.seq: r.new_name for r in ingest.resolved(spark.createDataFrame(new, "base_id string, file_name string, seq long"), spark.createDataFrame(stored, "base_id string, file_name string"), "rename").collect()}
    used = {(b, n) for b, n in stored} | {(b, n) for b, n, _ in new}
    seen, taken = set(stored), set()
    for b, n, i in new:
        if (b, n) not in seen:
            seen.add((b, n))
            assert got[i] == n
            continue
        dot = n.rfind(".") if n.rfind(".") > 0 else len(n)
        k = 1
        while (b, f"{n[:dot]}_{k}{n[dot:]}") in used | taken:
            k += 1
        taken.add((b, f"{n[:dot]}_{k}{n[dot:]}"))
        assert got[i] == f"{n[:dot]}_{k}{n[dot:]}", (n, got[i])


def test_a_name_of_many_files(spark):
    new = spark.range(100_000).select(F.lit("b").alias("base_id"), F.lit("n.md").alias("file_name"), F.col("id").alias("seq"))
    out = ingest.resolved(new, new.where("false"), "rename")
    r = out.agg(F.count_distinct("new_name").alias("names"), F.max(F.when(F.col("seq") == 99_999, F.col("new_name"))).alias("last")).first()
    assert (r.names, r["last"]) == (100_000, "n_99999.md")


def test_embedding_in_batches(spark):
    texts = [(i, None if i == 7 else "t" * i) for i in range(75)]
    rows = spark.createDataFrame(texts, "id long, search_text string").coalesce(1)

    def service(fails=0, wrong=False):
        def make():
            seen = []

            def call(batch):
                seen.append(len(batch))
                if len(seen) <= fails:
                    raise OSError("down")
                return [[float(len(t)), float(len(batch))] for t in batch][: -1 if wrong else None]

            return call

        return make

    got = {r.id: r.embedding for r in ingest.embed_batches(rows, "search_text", service(2), batch=32, base=0.001).collect()}
    assert got[7] is None and all(got[i][0] == i for i in range(75) if i != 7)
    assert max(v[1] for v in got.values() if v) == 32
    with pytest.raises(Exception, match="down"):
        ingest.embed_batches(rows, "search_text", service(3), attempts=3, base=0.001).collect()
    with pytest.raises(Exception, match="vectors for"):
        ingest.embed_batches(rows, "search_text", service(wrong=True), base=0.001).collect()
    tokens = ingest.embed_batches(rows.where("id < 3"), "search_text", lambda: lambda b: [[[1.0, 0.0], [3.0, 2.0]] for _ in b], pooling="mean").first()
    assert tokens.embedding == [2.0, 1.0]


def test_reuse_and_embedding(spark):
    stored = spark.createDataFrame([(1, "h1", "m", [1.0]), (2, "h1", "m", [2.0]), (3, "h2", "other", [3.0]), (4, "h3", "m", None)], "chunk_id long, embedding_text_hash string, embedding_model string, embedding array<float>")
    new = spark.createDataFrame([("h1", "a b"), ("h2", "c"), ("h3", "d")], "embedding_text_hash string, search_text string")
    out = {r.embedding_text_hash: r.embedding for r in ingest.embedded(new, stored, ingest.hashing_embedder(8), "m").collect()}
    assert out["h1"] == [1.0] and len(out["h2"]) == len(out["h3"]) == 8



def test_small_rules():
    assert ingest.model_route(0, True, 0, None, "m") == "save"
    assert ingest.model_route(3, False, 0, None, "m") == "backfill"
    assert ingest.model_route(3, True, 0, None, "m") == ingest.model_route(3, False, 0, "a", "b") == "refuse"
    calls, waits = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return 7

    assert ingest.with_retry(flaky, sleep=waits.append) == 7 and waits == [1.0, 2.0]


# --- sources


def zipped(**entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in entries.items():
            z.writestr(k.replace("__", "/").replace("_dot_", "."), v)
    return out.getvalue()


def test_parsers(spark):
    docx = zipped(word__document_dot_xml="<d xmlns:w='w'><w:p><w:t>Hello </w:t><w:t>there</w:t></w:p><w:p><w:t>End</w:t></w:p></d>")
    pptx = zipped(ppt__slides__slide10_dot_xml="<s><t>ten</t></s>", ppt__slides__slide2_dot_xml="<s><t>two</t></s>")
    xlsx = zipped(xl__sharedStrings_dot_xml="<sst><si><t>a</t></si><si><r><t>b</t></r><r><t>c</t></r></si></sst>", xl__worksheets__sheet1_dot_xml="<w><row><c t='s'><v>1</v></c><c><v>3.5</v></c><c t='b'><v>1</v></c></row><row/><row><c t='inlineStr'><is><t>in</t></is></c></row></w>")
    epub = zipped(a_dot_xhtml="<h1>One</h1><p>x</p>", nav_dot_xhtml="<p>no</p>")
    rows = [("a.docx", docx), ("b.pptx", pptx), ("c.xlsx", xlsx), ("d.epub", epub), ("e.html", b"<head><title>T</title></head><p>hi <b>x</b></p>"), ("f.txt", b"\xef\xbb\xbfplain"), ("g.docx", b"junk"), ("h.pdf", b"%PDF")]
    df = spark.createDataFrame([(n, bytearray(c)) for n, c in rows], "path string, content binary")
    got = {r.path: r for r in files.parsed(df).collect()}
    assert got["a.docx"].text == "Hello there\nEnd"
    assert got["b.pptx"].text == "two\n\nten"
    assert got["c.xlsx"].text == "bc\t3.5\t1\nin"
    assert got["d.epub"].text == "# One\n\nx"
    assert (got["e.html"].title, got["e.html"].text) == ("T", "hi **x**")
    assert got["f.txt"].text == "plain"
    assert got["g.docx"].error.startswith("parse_failed") and got["h.pdf"].error.startswith("parse_failed")


def test_pdf():
    assert files.parse_pdf(samples.pdf(["Hello (there)", "déjà 知识", ""])) == "Hello (there)\ndéjà 知识"
    plain = b"%PDF-1.3\n1 0 obj\n<< /Length 60 >>\nstream\nBT (a \\(b\\) \\351) Tj T* [(one) -300 (two) 20 (three)] TJ ET\nendstream\nendobj"
    assert files.parse_pdf(plain) == "a (b) é\none twothree"
    for raw in (b"%PDF-1.4 /Encrypt", b"junk", samples.pdf([])):
        with pytest.raises(ValueError):
            files.parse_pdf(raw)
    with pytest.raises(ValueError):
        files.parse_docx(samples.docx(["x"], 300 << 20))


def test_decode():
    assert files.decode_text("知识库管理系统功能".encode("gb18030")) == "知识库管理系统功能"
    assert files.decode_text(b"caf\xe9") == "caf�"


def test_markdown():
    html = "<nav>menu</nav><h2>Head</h2><p>a <strong>b</strong></p><ul><li>x</li><li>y</li></ul><pre>code\n  two</pre><footer>f</footer>"
    assert html_markdown(html) == "## Head\n\na **b**\n\n- x\n- y\n\n```\ncode\n  two\n```"


# --- stream


def test_stream_equals_batch(spark, tmp_path):
    rows = [("b", f"d{i}", f"t{i}", f"text {i % 7}\n\nmore {i % 7}", i) for i in range(20)]
    df = spark.createDataFrame(rows, "base_id string, doc_id string, title string, raw_text string, n long").select("base_id", "doc_id", "title", "raw_text", F.timestamp_seconds("n").alias("created_at"))
    folder = "file://" + str(tmp_path)
    df.write.parquet(folder + "/in")
    stream.start(stream.chunk_stream(stream.source(spark, folder + "/in")), folder + "/out", folder + "/state").awaitTermination()
    out = spark.read.parquet(folder + "/out")
    none = df.select("base_id", "doc_id", "title", "raw_text").withColumn("content_hash", F.lit("")).where("false")
    _, batch = ingest.ingested(df.select("base_id", "doc_id", "title", "raw_text"), none, none)
    assert sorted(r.text for r in out.collect()) == sorted(r.text for r in batch.collect())
    assert out.count() == 14


def test_stream_of_upserts_survives_a_stop(spark, tmp_path):
    """A stop before a commit, and one between a commit and the stream's record of it: run again, the result is that of a batch."""
    from stackwise.operators.chunking import finished, with_chunks
    from stackwise.operators.store import ChunkStore

    root = f"file://{tmp_path}"
    store = ChunkStore(spark, root + "/store", "search_text")
    schema = "base_id string, doc_id string, title string, raw_text string, created_at timestamp"
    first = spark.createDataFrame([("b", f"d{i}", f"t{i}", f"Text {i}. " * 30) for i in range(6)], schema.rpartition(",")[0]).withColumn("created_at", F.current_timestamp())
    second = spark.createDataFrame([("b", "d1", "t1", "Another text."), ("b", "d2", "t2", ""), ("b", "new", "n", "New.")], schema.rpartition(",")[0]).withColumn("created_at", F.current_timestamp())
    start = lambda **o: stream.upserts(stream.source(spark, root + "/in"), store, "s", root + "/state", size=64, overlap=8, **o)

    def stop(number):
        raise OSError("stopped")

    first.write.mode("append").parquet(root + "/in")
    with pytest.raises(Exception, match="stopped"):
        start(before_commit=stop).awaitTermination()
    assert store.snapshot().version == 0
    start().awaitTermination()
    assert store.snapshot().version == 1
    second.write.mode("append").parquet(root + "/in")
    put = store.put

    def put_and_stop(*a, **k):
        put(*a, **k)
        raise OSError("stopped after the commit")

    store.put = put_and_stop
    with pytest.raises(Exception, match="after the commit"):
        start().awaitTermination()
    del store.put
    assert store.snapshot().version == 2
    start().awaitTermination()
    assert store.snapshot().version == 2 and store.snapshot().state["applied"] == {"s": 1}
    want = first.where("doc_id not in ('d1', 'd2')").unionByName(second.where("raw_text <> ''"))
    want = finished(with_chunks(want.select("base_id", "doc_id", "title", "raw_text"), size=64, overlap=8))
    ids = lambda df: sorted((r.chunk_id, r.text) for r in df.select("chunk_id", "text").collect())
    assert ids(store.snapshot().rows()) == ids(want)


def test_outline_in_the_order_of_a_language(spark):
    rows = [("a", None, "zebra"), ("b", None, "Éclair"), ("c", None, "eclair"), ("d", None, "Zebra"), ("e", None, "edge"), ("f", "b", "b"), ("g", "b", "B"), ("h", "b", "a"), ("i", "c", "z"), ("j", None, None), ("k", None, "eclair")]
    docs = spark.createDataFrame(rows, "doc_id string, parent_directory_id string, title string")
    order = lambda **o: "".join(r.doc_id for r in catalog.outline(docs, **o).orderBy("position").collect())
    # no title, eclair twice (each with what is below it), Éclair with a, b, B, then edge, zebra, Zebra
    assert order(collation="UNICODE") == "jcikbhfgead"
    assert order() == "jdcikeabghf"
