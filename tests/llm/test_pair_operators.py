"""WARC, SimHash, top-k, embedding near-duplicates, components and the pipeline against brute force and on odd input."""

import base64
import hashlib
import io
import random
import zlib

import numpy as np
import pytest
import xxhash
from oracle import check
from pyspark.sql import functions as F

import corpus_pipeline
from stackwise.llm import queries, simhash, topk, vecdedup, warc
from stackwise.llm.components import components
from stackwise.llm.shards import Unions


def joined(pairs, nodes):
    """Smallest node reachable, plainly."""
    name = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            m = min(name[a], name[b])
            if name[a] != m or name[b] != m:
                name[a] = name[b] = m
                changed = True
    return name


# --- WARC


def test_warc_equals_sql(spark, sf):
    check(queries.QUERIES["op5_warc"](spark, sf), queries.ORACLES["op5_warc"], sf)


def test_warc_odd(spark):
    rows = [(1, "http://a", "same"), (2, None, "same"), (9, "http://b/\r\nX: y", "same"), (9, "http://b", "same"), (3, "u", None), (4, "u", ""), (None, "u", "alone"), (5, "é", "\x1f\x8b\x08 not a member é"), (None, "u", "twice"), (None, "u", "twice"), (6, "u", "long " * 300_000)]
    df = spark.createDataFrame([(*r, "d", "r") for r in rows], "page_id long, url string, html string, digest string, revisit string")
    out = warc.round_trip(df, split_bytes=64)
    sha = lambda s: base64.b32encode(hashlib.sha1((s or "").encode()).digest()).decode()
    size = lambda s: len((s or "").encode())
    want = [(p, size(h), sha(h), "revisit" if (p, h) in ((1, "same"), (2, "same")) or p == 3 else "response", 9 if (p, h) in ((1, "same"), (2, "same")) else 4 if p == 3 else None) for p, _, h in rows]
    assert sorted(map(str, (tuple(r) for r in out.collect()))) == sorted(map(str, want))
    assert warc.round_trip(df.where("false")).count() == 0
    kinds = {r.page_id: r.record_type for r in warc.round_trip(df.where("page_id in (3, 4)"), smallest=1).collect()}
    assert kinds == {3: "response", 4: "response"}


def test_warc_ranges_are_read_by_many_tasks(spark):
    rng = random.Random(8)
    rows = [(i, "u", "".join(rng.choice("abcdefghij") for _ in range(2000))) for i in range(69)]
    out = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string"), split_bytes=1000)
    tasks = out.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n")).collect()
    assert len(tasks) >= 30 and sum(r.n for r in tasks) == 69


def test_warc_ranges():
    rng = random.Random(4)
    payloads = [bytes(rng.randrange(256) for _ in range(rng.choice([0, 5, 700, 5000]))) + warc.MAGIC * 3 for _ in range(40)]
    digest = lambda p: base64.b32encode(hashlib.sha1(p).digest()).decode()

    def member(raw, level):
        z = zlib.compressobj(level, zlib.DEFLATED, 31)
        return z.compress(raw) + z.flush()

    # stored members, so that magic in a payload is magic in the file
    whole = b"".join(member(warc.record(i, "u", p, digest(p), None, False), 0) for i, p in enumerate(payloads))
    for step in (37, 1000, 10**6):
        found = [r for a in range(0, len(whole), step) for r in warc.read_range(io.BytesIO(whole), a, min(len(whole), a + step))]
        assert [(r[0], r[1], r[2]) for r in found] == [(i, len(p), digest(p)) for i, p in enumerate(payloads)]
    broken = member(warc.record(1, "u", b"abc", digest(b"abd"), None, False), 6)
    with pytest.raises(ValueError):
        list(warc.read_range(io.BytesIO(broken), 0, len(broken)))


# --- components


def test_components(spark):
    rng = random.Random(7)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(1, 50)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    nodes = {n for p in pairs for n in p}
    want = joined(pairs, nodes)
    linked = {n for a, b in pairs if a != b for n in (a, b)}
    assert got == {n: want[n] for n in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- SimHash


def fingerprint(text, words=3):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    s = [" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints():
    rng = random.Random(1)
    texts = ["", "One", "one TWO", "É é\x85x y z", "a b\tc\x0bd\re", "x " * 700] + [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 900))) for _ in range(30)]
    assert [int.from_bytes(f, "big") for f in simhash.fingerprints(texts, 3, 64)] == [fingerprint(t) for t in texts]
    assert [f[:8] for f in simhash.fingerprints(texts, 3, 512)] == simhash.fingerprints(texts, 3, 64)


def test_xxhash_is_the_engine_s(spark):
    r = spark.sql("select xxhash64('the quick fox') as h").first().h
    assert int.from_bytes(simhash.shingle_hashes("The QUICK fox", 3), "big", signed=True) == r


def near_bits(n, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, n).astype(np.uint64)
    for i in range(n // 2, n):  # near copies, some in long chains and one large ball
        x[i] = x[i - 1 if i % 3 else n // 2] ^ np.uint64(sum({1 << int(b) for b in rng.integers(0, 64, rng.integers(1, 5))}))
    return np.unique(x)


def test_links_equal_all_pairs(spark):
    x = near_bits(3000)
    rows = [(i, int(v).to_bytes(8, "big")) for i, v in enumerate(x)]
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in rows], "id long, fp binary")
    scheme = simhash.Scheme(words=3, bits=64, radius=3, pieces=2, piece_radius=1, leaf=100)
    got = {r.node: r.component for r in components(simhash.links(df, scheme, sample=500)).collect()}
    u = Unions(len(x))
    for i in range(len(x)):
        u.merge(np.full(len(x), i)[np.bitwise_count(x ^ x[i]) <= 3], np.flatnonzero(np.bitwise_count(x ^ x[i]) <= 3))
    assert [got.get(i, i) for i in range(len(x))] == u.name.tolist()


def test_overfull_leaves_are_cut_again(spark):
    """A sample far too small for the table: leaves stay small by trees of their own, and no link is lost."""
    x = near_bits(4000, 4)
    scheme = simhash.Scheme(words=3, bits=64, radius=3, pieces=2, piece_radius=1, leaf=10)
    df = spark.createDataFrame([(i, bytearray(int(v).to_bytes(8, "big"))) for i, v in enumerate(x)], "id long, fp binary")
    cuts, most = [], []
    keep = simhash.finer

    def watched(assigned, scheme, sample):
        out = keep(assigned, scheme, sample)
        size = lambda d: [r.h for r in d.groupBy("shard").agg(F.count_if("home").alias("h")).collect()]
        cuts.append(max(size(assigned))), most.extend(size(out))
        return out

    simhash.finer = watched
    try:
        got = {r.node: r.component for r in components(simhash.links(df, scheme, sample=60)).collect()}
    finally:
        simhash.finer = keep
    u = Unions(len(x))
    for i in range(len(x)):
        near = np.flatnonzero(np.bitwise_count(x ^ x[i]) <= 3)
        u.merge(np.full(len(near), i), near)
    assert [got.get(i, i) for i in range(len(x))] == u.name.tolist()
    # but for the large ball, whose pieces are equal
    assert cuts[0] > 100 and sorted(most)[-5] <= simhash.OVERFULL * scheme.leaf and len(most) > 300


def test_tree_meets_every_near_pair():
    x = near_bits(2000, 3)
    piece = simhash.piece_of(x[:, None], simhash.CONTRACT, 0)
    tree = simhash.Tree(piece[:500], 1, 32, 20, 0)
    rows, leaves, home = tree.places(piece)
    assert tree.leaves > 8 and sorted(rows[home]) == list(range(len(x)))
    at = dict(zip(rows[home].tolist(), leaves[home].tolist()))
    visits = set(zip(rows.tolist(), leaves.tolist()))
    for i in range(0, len(x), 7):
        for j in np.flatnonzero(np.bitwise_count(piece ^ piece[i]) <= 1):
            assert (i, at[int(j)]) in visits or (int(j), at[i]) in visits


def test_large_ball_is_linked_without_all_pairs():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 1, dtype=np.uint64)[0]
    x = np.unique(np.array([base ^ np.uint64((1 << int(a)) | (1 << int(b))) for a in range(64) for b in range(a)] + [base], dtype=np.uint64))[:, None]
    a, b = simhash.linked(x, len(x), 3)
    assert len(a) == len(x) - 1


def test_simhash_odd(spark):
    rows = [(5, None), (3, ""), (7, " \t"), (1, "a b c d e"), (2, "A B c\nd e"), (2, "A B c\nd e"), (None, "a b c d e"), (9, "other words here " * 5000), (4, "one"), (6, "ONE")]
    df = spark.createDataFrame([(*r, "c", "f") for r in rows], "doc_id long, text string, component string, fp string")
    out = simhash.detect(df).collect()
    assert all(int(r.fingerprint, 16) == fingerprint(dict(rows)[r.doc_id]) and len(r.fingerprint) == 16 for r in out)
    assert {(r.doc_id, r.component_id) for r in out} == {(5, 3), (3, 3), (7, 3), (1, 1), (2, 1), (None, None), (9, 9), (4, 4), (6, 4)} and len(out) == 10
    assert simhash.detect(df.where("false")).count() == 0


def test_simhash_of_documents(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r.text for r in df.collect()}
    fp = {k: fingerprint(v) for k, v in rows.items()}
    want = joined([(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 3], fp)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.QUERIES["op6_simhash"](spark, sf).collect()}
    assert got == {k: (f"{fp[k]:016x}", want[k]) for k in fp}


def test_pipeline_scheme_finds_near_copies(spark):
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(5000)]
    texts = [[rng.choice(vocab) for _ in range(300)] for _ in range(150)]
    rows, planted = [(i, " ".join(t)) for i, t in enumerate(texts)], []
    shingles = lambda t: {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
    for i, t in enumerate(texts[:120]):
        c = list(t)
        for _ in range(rng.randint(1, 6)):
            c[rng.randrange(len(c))] = rng.choice(vocab)
        a, b = shingles(t), shingles(c)
        if len(a & b) / len(a | b) >= 0.8:
            planted.append((i, 1000 + i))
        rows.append((1000 + i, " ".join(c)))
    kept = {r.doc_id for r in simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(range(150)) <= kept
    assert len(planted) > 60 and sum(b not in kept for _, b in planted) >= 0.95 * len(planted)


def copies_at(rng, n, size=200):
    """Pairs of sets of numbers with a Jaccard similarity of 0.8."""
    common, own = round(size * 0.8), round(size * 0.1)
    x = rng.integers(0, 2**63, (n, common + 2 * own), dtype=np.uint64)
    return [(np.sort(r[: common + own]), np.sort(np.r_[r[:common], r[common + own :]])) for r in x]


def test_bands_do_not_depend_on_the_number_of_documents():
    rng = np.random.default_rng(12)
    pairs = copies_at(rng, 3000)
    keys = []
    for side in zip(*pairs):
        # a set's bands are those it has alone, whatever else is there
        bands = simhash.bands_of(np.concatenate(side), np.array([len(x) for x in side]), simhash.PIPELINE)
        assert (simhash.bands_of(side[7], np.array([len(side[7])]), simhash.PIPELINE) == bands[7]).all()
        keys.append(bands)
    assert (keys[0] == keys[1]).any(1).mean() >= 0.999
    # and others share hardly any
    assert (keys[0][1:] == keys[0][:-1]).any(1).sum() == 0


def five_words(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_copies(rows):
    """Ids that stay: the smallest of every group of texts with a similarity of 0.8."""
    sets = {i: five_words(t) for i, t in rows}
    near = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) * 1.8 >= 0.8 * (len(sets[a]) + len(sets[b])) - 1e-9]
    name = joined(near, sets)
    return {i for i in sets if name[i] == i}


def test_only_near_copies_go(spark):
    rng = random.Random(31)
    vocab = [f"w{i}" for i in range(5000)]
    words = lambda n: [rng.choice(vocab) for _ in range(n)]
    rows = []
    for i in range(60):
        t = words(280)
        # contained in a text 1.4 times as long, the halves of a chain, and short ones of four and five shingles
        rows += [(i, " ".join(t[:200])), (1000 + i, " ".join(t))]
        c = words(60)
        rows += [(2000 + 10 * i + k, " ".join(c[3 * k : 3 * k + 40])) for k in range(5)]
        s = words(9)
        rows += [(4000 + i, " ".join(s)), (5000 + i, " ".join(s[:8]))]
    rows += [(9000, "said often " * 50 + "and so on and on"), (9001, "said often " * 9 + "and so on and on"), (9002, None), (9003, "")]
    kept = {r.doc_id for r in simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == brute_copies(rows)
    assert {*range(60), *range(1000, 1060)} <= kept and not {*range(5000, 5060)} & kept


def test_copies_meet_in_vantage_point_trees(spark, monkeypatch):
    """Without any band the trees find every pair within their radius, and what they find is verified."""
    rng = random.Random(17)
    vocab = [f"w{i}" for i in range(5000)]
    rows = []
    for i in range(40):
        t = [rng.choice(vocab) for _ in range(600)]
        rows += [(i, " ".join(t)), (1000 + i, " ".join(t[:-1] + ["end"])), (2000 + i, " ".join(rng.choice(vocab) for _ in range(50)))]
    rows += [(3000, "a b c d e"), (3001, None), (3002, " ")]
    # half of the shingles again and again: equal majorities, and a similarity below 0.8
    base = "p q r s t u v w x y z".split()
    rows += [(4000, " ".join(base * 40)), (4001, " ".join(base * 40 + [f"n{i}" for i in range(12)]))]
    fps = dict(zip([i for i, _ in rows], simhash.words_of([f[:8] for f in simhash.fingerprints([t or "" for _, t in rows], 5, 512)])[:, 0]))
    sets = {i: five_words(t) for i, t in rows}
    near = [(a, b) for a in sets for b in sets if a < b and int(fps[a] ^ fps[b]).bit_count() <= 3]
    good = [(a, b) for a, b in near if len(sets[a] & sets[b]) * 1.8 >= 0.8 * (len(sets[a]) + len(sets[b])) - 1e-9]
    assert len(good) >= 20
    monkeypatch.setattr(simhash, "candidates", lambda classes, scheme: spark.createDataFrame([], "a long, b long"))
    name = joined(good, sets)
    kept = {r.doc_id for r in simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {i for i in sets if name[i] == i}


def test_alike_equals_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    sets = [np.unique(np.r_[base[: rng.integers(40, 61)], rng.integers(0, 2**63, rng.integers(1, 12), dtype=np.uint64)]) for _ in range(150)]
    near = [(i, j) for i in range(150) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j])) - 1e-9]
    for homes, cross in ((150, False), (70, True)):
        a, b = simhash.alike(sets, homes, 0.8, cross)
        want = [p for p in near if not cross or (p[0] < 70) != (p[1] < 70)]
        assert joined(list(zip(a.tolist(), b.tolist())), range(150)) == joined(want, range(150))
    # a group of many texts is dealt to parts, and one of long texts too
    text = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join([*text, f"x{i}"])) for i in range(60)]
    for name, most in (("MOST_SETS", 10), ("MOST_SHINGLES", 1000)):
        with monkeypatch.context() as m:
            m.setattr(simhash, name, most)
            assert [r.doc_id for r in simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()] == [0]


def test_shards_of_heavy_rows_are_dealt(spark):
    from stackwise.llm import shards

    rows = spark.createDataFrame([("s", True, i, 100) for i in range(80)] + [("t", True, i, 1) for i in range(80)], "shard string, home boolean, id long, size int")
    out = shards.dealt(rows, "id", 1000, F.col("size"), 1000).collect()
    by = {}
    for r in out:
        by.setdefault((r.shard, r.part, r.cross), []).append(r.size)
    assert len([k for k in by if k[0] == "t"]) == 1 and len([k for k in by if k[0] == "s"]) > 30
    assert max(sum(x) for k, x in by.items() if k[0] == "s") < 4500


def test_one_row_of_each_group_stays_with_repeated_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(50)) for x in "abc")
    rows = [(1, a, "x"), (2, a, "x"), (2, b, "x"), (3, c, "x"), (3, c, "x"), (3, c, "y"), (4, c, "x"), (None, a, "x"), (None, a, "x")]
    out = simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted(map(str, map(tuple, out))) == sorted(map(str, [(1, a, "x"), (2, b, "x"), (3, c, "x"), (None, a, "x"), (None, a, "x")]))


# --- top-k


def brute_topk(rows, k=5, every=50):
    v = {i: np.floor(256 * np.array(x, dtype=np.float32).astype(float)) for i, x in rows}
    out = []
    for q in v:
        if q % every == 0:
            best = sorted((-(v[q] @ v[c]), c) for c in v if c != q)[:k]
            out += [(q, n + 1, c, int(-s)) for n, (s, c) in enumerate(best)]
    return sorted(out)


def test_topk_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES_PER_BLOCK", 150)
    monkeypatch.setattr(topk, "QUERIES_PER_BLOCK", 4)
    rng = np.random.default_rng(2)
    x = rng.integers(-3, 4, (600, 6)) / 8  # many ties
    x[::7] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0)
    assert sorted(tuple(r) for r in got.collect()) == brute_topk(rows)


def test_threshold_stops_early():
    rng = np.random.default_rng(3)
    x = np.abs(rng.standard_normal((20_000, 3))) ** 4 * 100 // 1
    lists = topk.SortedLists(np.arange(len(x)), x)
    scored = []
    original, lists._top = lists._top, lambda rows, scores, k: (scored.append(len(rows)), topk.SortedLists._top(rows, scores, k))[1]
    ids, scores = lists.best(-1, np.array([3.0, 1.0, 2.0]), 5)
    want = np.lexsort((np.arange(len(x)), -(x @ [3, 1, 2])))[:5]
    assert ids.tolist() == want.tolist() and sum(scored) < len(x) / 4


def test_topk_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, None), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, [None, 1.0]), (5, []), (6, [1.0, 2.0]), (7, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (50, [0.0, 0.0]), (8, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, block int, q int")
    got = sorted(tuple(r) for r in topk.search(df, F.col("vec_id") % 50 == 0).collect())
    s = 256 * 256 * 5
    assert got == [(0, 1, 6, s), (0, 2, 8, s), (0, 3, 50, 0), (50, 1, 0, 0), (50, 2, 6, 0), (50, 3, 8, 0)]
    assert topk.search(df.where("false"), F.col("vec_id") % 50 == 0).count() == 0


# --- embeddings


def brute_near(rows, least=0.9):
    ids, x = [i for i, _ in rows], np.array([v for _, v in rows], dtype=np.float32).astype(float)
    n = np.sqrt((x * x).sum(1))
    c = (x @ x.T) / np.outer(n, n)
    pairs = [(ids[a], ids[b]) for a, b in zip(*np.nonzero(c >= least)) if a < b]
    links = {i: 0 for i in ids}
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    return links, joined(pairs, ids), pairs


def test_embeddings_recall(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((1500, 64))
    for i in range(600, 1500):
        j = rng.integers(0, 600) if i % 4 else 3  # a large group
        x[i] = x[j] / np.linalg.norm(x[j]) + rng.standard_normal(64) * rng.uniform(0, 0.08)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    links, _, pairs = brute_near(rows)
    got = {r.vec_id: r for r in vecdedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert all(got[i].n_links <= links[i] for i in links)
    assert sum(r.n_links for r in got.values()) >= 0.97 * 2 * len(pairs)


def test_embeddings_recall_over_many_cells(spark, monkeypatch):
    monkeypatch.setattr(vecdedup, "ROWS_PER_CELL", 16)
    cells = []
    fitted = vecdedup.Index.fitted.__func__
    monkeypatch.setattr(vecdedup.Index, "fitted", classmethod(lambda cls, *a: (cells.append(fitted(cls, *a)), cells[-1])[1]))
    rng = np.random.default_rng(19)
    x = rng.standard_normal((2000, 64))
    for i in range(800, 2000):
        j = rng.integers(0, 800)
        x[i] = x[j] / np.linalg.norm(x[j]) + rng.standard_normal(64) * rng.uniform(0, 0.08)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    links, _, pairs = brute_near(rows)
    got = {r.vec_id: r for r in vecdedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert [len(c.first) * len(c.second) for c in cells] == [121]
    assert all(got[i].n_links <= links[i] for i in links)
    found = sum(r.n_links for r in got.values()) / (2 * len(pairs))
    print("recall", found, "pairs", len(pairs))
    assert found >= 0.97


def test_traversal_is_in_order_of_distance():
    rng = np.random.default_rng(3)
    for _ in range(20):
        a, b = (np.sort(np.r_[0, rng.random(rng.integers(0, 12)).round(1)]) for _ in range(2))
        got = list(vecdedup.nearest_cells(a.tolist(), b.tolist(), 0.9))
        assert [d for *_, d in got] == sorted(d for *_, d in got)
        assert sorted((i, j) for i, j, _ in got) == [(i, j) for i in range(len(a)) for j in range(len(b)) if a[i] + b[j] <= 0.9]


def test_codes_grow_with_the_table():
    assert [vecdedup.codes_for(n) for n in (0, 1000, 1024 * 100, 10**9, 10**10, 10**12)] == [1, 1, 10, 988, 3125, 4096]


def test_embeddings_of_the_table(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    links, name, pairs = brute_near(rows)
    got = {r.vec_id: r for r in queries.QUERIES["op8_near_vectors"](spark, sf).collect()}
    assert sum(r.n_links for r in got.values()) >= 0.9 * 2 * len(pairs)
    assert np.mean([got[i].component_id == name[i] for i in name]) >= 0.95


def test_embeddings_odd(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [2.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [None, 1.0]), (8, [1.0, 0.0, 0.0]), (9, []), (None, [1.0, 0.0]), (10, [0.0, 1.0]), (2, [1.0, 0.0])]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "vec_id long, embedding array<float>, links int, component string")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in vecdedup.near_duplicates(df).collect()), key=str)
    want = [(1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (3, 3, 1, False), *[(i, 0, i, True) for i in (4, 5, 6, 7, 8, 9, 10)], (None, 0, None, True)]
    assert got == sorted(want, key=str)
    assert vecdedup.near_duplicates(df.where("false")).count() == 0


def test_large_shards_are_dealt(spark):
    from stackwise.llm import shards

    rows = [("s", True, i) for i in range(50)] + [("s", False, 100 + i) for i in range(25)] + [("t", True, 200), ("t", False, 201), ("u", False, 300)]
    out = shards.dealt(spark.createDataFrame(rows, "shard string, home boolean, id long"), "id", most=10).collect()
    by, met = {}, []
    for r in out:
        by.setdefault((r.shard, r.part), []).append(r)
    for group in by.values():
        homes, guests = [r.id for r in group if r.home], [r.id for r in group if not r.home]
        assert len({r.cross for r in group}) == 1
        met += [frozenset((a, b)) for a in homes for b in guests]
        if not group[0].cross:
            met += [frozenset((a, b)) for a in homes for b in homes if a < b]
    want = [frozenset((a, b)) for a in range(50) for b in [*range(a), *range(100, 125)]] + [frozenset((200, 201))]
    assert sorted(map(sorted, met)) == sorted(map(sorted, want))
    assert max(map(len, by.values())) < 50
    # the parts of one shard are in many tasks
    rows = spark.createDataFrame([("s", True, i) for i in range(2000)], "shard string, home boolean, id long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tasks = shards.dealt(rows, "id", most=100).groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(tasks) > 1 and max(r["count"] for r in tasks) < 0.6 * sum(r["count"] for r in tasks)


def test_counts_of_a_large_cell(spark, monkeypatch):
    monkeypatch.setattr(vecdedup, "MOST_ROWS", 40)
    rng = np.random.default_rng(1)
    base = rng.standard_normal(8)
    rows = [(i, (base + rng.standard_normal(8) * 0.12).tolist()) for i in range(300)]
    links, name, _ = brute_near(rows)
    got = {r.vec_id: (r.n_links, r.component_id) for r in vecdedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert got == {i: (links[i], name[i]) for i in links}


# --- pipeline


def test_pipeline(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        sizes.append(docs.count())
        if name in ("quality", "language", "near_duplicates"):
            assert docs.columns == columns and all(before[r.doc_id] == r.text for r in docs.collect())
    assert sizes[1] < sizes[0] and sizes[3] < sizes[2] and sizes[5] > 0
    assert {r.doc_id for r in docs.collect()} <= set(before)


def test_pipeline_odd(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, row string, id long"
    rows = [(1, None, "en", "a"), (2, "", None, None), (3, "good words in here " * 40, "en", "a"), (3, "good words in here " * 40, "en", "a"), (None, "good words without id", "en", None), (4, "12 34", "en", "b")]
    docs = spark.createDataFrame([(*r, 1, 0.1, "k", "r", 7) for r in rows], schema)
    spark.createDataFrame([(3, 1), (99, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    for frame in (docs, docs.where("false")):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, frame, str(tmp_path))
            assert out.columns == docs.columns, name
            out.collect()
        pieces = corpus_pipeline.STAGES[-1][1](spark, frame, str(tmp_path)).collect()
        assert {p.doc_id for p in pieces} == {r.doc_id for r in frame.collect()}
