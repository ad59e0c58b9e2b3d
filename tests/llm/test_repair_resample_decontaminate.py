"""Conversation repair, importance resampling and decontamination against SQL, brute force and odd input."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from functools import lru_cache

import pytest
from oracle import check

from stackwise.llm import decontaminate, queries, repair, resample


@pytest.mark.parametrize("name", ["op11_repair", "op12_resample", "op13_decontaminate"])
def test_equals_sql(spark, sf, name):
    check(queries.QUERIES[name](spark, sf), queries.ORACLES[name], sf)


def same_rows(df, want):
    got = sorted((tuple(r) for r in df.collect()), key=str)
    assert got == sorted(want, key=str)


# --- repair

NEXT = {"": "su", "s": "u", "u": "a", "a": "u"}


def plain_edits(rows):
    """Cheapest (cost, audit) of rows (initial, truncated, dead), edit by edit."""

    @lru_cache(None)
    def best(i, last, inserts):
        ways = [(0, "")] if i == len(rows) and last in ("", "a") else []
        if i < len(rows):
            initial, cut, dead = rows[i]
            c, a = best(i + 1, last, 2)
            ways.append((c + 3, "D" + a))
            if not dead:
                if initial and initial in NEXT[last]:
                    c, a = best(i + 1, initial, 2)
                    ways.append((c + cut, "K" + a))
                for r in set("ua") & set(NEXT[last]):
                    c, a = best(i + 1, r, 2)
                    ways.append((c + 2 + cut, "R" + a))
        for r in set("ua") & set(NEXT[last]) if inserts else ():
            c, a = best(i, r, inserts - 1)
            ways.append((c + 2, "I" + a))
        return min(ways, default=(10**9, ""))

    return best(0, "", 2)


def plain_repair(rows):
    """The contract's row for rows (turn, role, text) of one conversation, nulls told apart already."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2][:100].encode(), hashlib.sha256(r[2].encode()).hexdigest()))
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\f\r")
        faults.append(1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0)
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    cost, audit = plain_edits([(r[:1] if r[:1] in ("s", "u", "a") else "", int(f == 3), f in (1, 2)) for (_, r, _), f in zip(rows, faults)])
    lines, at, last = [], 0, ""
    for op in audit:
        role, text = ("", "") if op == "I" else rows[at][1:]
        at += op != "I"
        if op == "D":
            continue
        last = role[:1] if op == "K" else "u" if last != "u" else "a"
        lines.append(f"{role if op == 'K' else {'u': 'user', 'a': 'assistant'}[last]}:{text}")
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def some_rows(rng, conversations, longest):
    roles = ["user", "assistant", "system", "user", "assistant", "", "tool", "Umbrella", None]
    texts = ["Yes.", "no", " ", "", "Well?  \n", "x" * 120 + "1.", "x" * 120 + "2.", "é!", None]
    out = []
    for c in range(conversations):
        for t in range(rng.randint(1, longest)):
            out.append((c, rng.choice([t, t, t + 1, None]), rng.choice(roles), rng.choice(texts + [f"Text {rng.random()}."] * 6), "c", 5))
    return out


def wanted(rows, damage):
    per = {}
    for conv, turn, role, text, *_ in rows:
        per.setdefault(conv, [])
        role, text = role if role is not None else " ", text if text is not None else " "
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        per[conv] += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return [(c, *plain_repair(r)) for c, r in per.items()]


SCHEMA = "conv_id long, turn long, role string, text string, audit string, cost int"


@pytest.mark.parametrize("bits", [16, 2])
def test_repair_equals_brute_force(spark, bits):
    """With segments of four rows too, so that conversations go on over many of them."""
    rng = random.Random(11)
    rows = some_rows(rng, 150, 14) + [(None, t, "user", f"Null conversation {t}.", "c", 5) for t in range(20)] + [(77_000, 3, "user", "Only.", "c", 5)] * 9
    df = spark.createDataFrame(rows, SCHEMA)
    same_rows(repair.repaired(repair.damaged(df), df, bits), wanted(rows, True))
    same_rows(repair.repaired(df, segment_bits=bits), wanted(rows, False))


def test_repair_of_one_long_conversation(spark):
    """All rows in one conversation: the same by segments of 64 rows as in one piece."""
    rng = random.Random(5)
    rows = [(1, t, rng.choice(["user", "assistant", "system", "x"]), rng.choice([f"A {t}.", f"B {t}", "Same.", ""]), "c", 1) for t in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    whole, parts = repair.repaired(df).collect(), repair.repaired(df, segment_bits=6).collect()
    assert whole == parts and len(whole) == 1
    r, audit = whole[0], whole[0].audit
    light = repair.faults(repair.ordered(df.select("conv_id", "turn", "role", "text")), 6)
    assert light.select("seg").distinct().count() >= 40
    assert r.cost == 3 * audit.count("D") + 2 * (audit.count("I") + audit.count("R")) + sum(1 for op, row in zip(audit.replace("I", ""), sorted(rows, key=lambda x: x[1])) if op in "KR" and row[3][:1] == "B")


def test_repair_of_nothing(spark):
    df = spark.createDataFrame([(1, 0, "user", "Gone.", "c", 5)], SCHEMA)
    assert repair.repaired(df.where("false")).count() == 0
    same_rows(repair.repaired(df.where("false"), df), [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())])


def test_repair_of_a_long_text(spark):
    text = "long text " * 400_000
    df = spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", "Yes.")], "conv_id long, turn long, role string, text string")
    r = repair.repaired(df).first()
    assert (r.truncated, r.cost, r.audit) == (1, 1, "KK") and r.repaired_sha256 == hashlib.sha256(f"user:{text}\nassistant:Yes.".encode()).hexdigest()


# --- resampling


def plain_words(text):
    low = (text or "").translate({i: i + 32 for i in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain_features(text, longest):
    w = plain_words(text)
    return [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


@pytest.mark.parametrize("longest", [1, 3])
def test_resample_equals_brute_force(spark, longest, monkeypatch):
    monkeypatch.setattr(resample, "PIECE_BYTES", 50)
    monkeypatch.setattr(resample, "BLOCK_FEATURES", 100)
    rng = random.Random(3)
    word = lambda: rng.choice(["the", "Été", "of", "x9", "ÀB", "data", "日本", "Zed", "a", "b-c"])
    docs = [(i, " ".join(word() for _ in range(rng.choice([0, 5, 30, 60, 400]))), "w", 7) for i in range(90)]
    docs += [(5, "twice " * 25, "w", 7)] * 3 + [(None, "nobody " * 30, "w", 7)] * 2 + [(1000, None, "w", 7), (1001, "", "w", 7), (1002, "?!  -", "w", 7)]
    target = [(1, "data data of the Zed"), (2, None), (3, "日本 data")]
    out = resample.resample(spark.createDataFrame(docs, "doc_id long, text string, weight string, rank int").repartition(5), spark.createDataFrame(target, "item_id long, text string"), percent=37, longest=longest)
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = Counter(bucket(f) for d in docs for f in plain_features(d[1], longest)), Counter(bucket(f) for d in target for f in plain_features(d[1], longest))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000))))
    want = []
    for doc_id, text, *_ in docs:
        features = plain_features(text, longest)
        weight = sum(gain(bucket(f)) for f in features)
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        want.append([doc_id, len(plain_words(text)), len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((w for w in want if w[1] >= 20), key=lambda w: (-w[4], w[0] is not None, w[0] or 0))
    for i, w in enumerate(able[: 37 * len(able) // 100]):
        w[5] = i + 1
    same_rows(out.select("doc_id", "n_words", "n_features", "weight", "score", "rank"), [tuple(w) for w in want])


def test_matrix_holds_every_count(spark):
    docs = [(i, f"w{i % 3} w{i % 5} w{i % 3} common") for i in range(50)]
    blocks = resample.blocks(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)).collect()
    seen = {}
    for b in blocks:
        for i, d in enumerate(b.doc_ids):
            seen[d] = dict(zip(b.columns[b.pointers[i] : b.pointers[i + 1]], b.counts[b.pointers[i] : b.pointers[i + 1]]))
    assert seen == {i: dict(Counter(zlib.crc32(w.encode()) % 10_000 for w in t.split())) for i, t in docs}


def test_resample_of_nothing(spark):
    df = spark.createDataFrame([(1, "word " * 30)], "doc_id long, text string")
    assert resample.resample(df.where("false"), df).count() == 0
    r = resample.resample(df, df.where("false"), percent=100).first()
    assert (r.n_features, r.rank) == (30, 1) and r.weight == 30 * math.floor(1000 * math.log(10_030 / (31 * 10_000)))


# --- decontamination


def plain_hits(docs, items, window):
    windows = {}
    for item_id, text in items:
        w = plain_words(text)
        for i in range(max(1, len(w) - window + 1)) if w else ():
            windows.setdefault(tuple(w[i : i + window]), set()).add("" if item_id is None else str(item_id))
    out = []
    for doc_id, text, *_ in docs:
        w, hit, found = plain_words(text), set(), set()
        for n in {len(g) for g in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("most", [decontaminate.MOST_BROADCAST, 40])
def test_decontamination_equals_brute_force(spark, most, monkeypatch):
    """With keys in several passes too."""
    monkeypatch.setattr(decontaminate, "MOST_BROADCAST", most)
    rng = random.Random(13)
    word = lambda: rng.choice(["Ab", "ab", "É", "x1", "c", "of"] + [f"w{i}" for i in range(20)])
    items = [(i, " ".join(word() for _ in range(rng.choice([3, 7, 10, 12, 30])))) for i in range(25)] + [(None, "a null item of ten words and one more word is"), (3, "again item three with other words of its own for you"), (90, None), (91, ""), (92, "?!"), (93, "lone"), (94, "x of x of x of x of x of x of x")]
    docs = []
    for i in range(120):
        parts = [" ".join(word() for _ in range(rng.randint(0, 60)))]
        for _ in range(rng.choice([0, 0, 1, 2])):
            w = (rng.choice(items)[1] or "").split()
            a = rng.randint(0, max(0, len(w) - 5))
            parts += [", ".join(w[a : a + rng.choice([4, 9, 10, 11, 40])]).upper(), " ".join(word() for _ in range(rng.randint(0, 9)))]
        docs.append((i, " ".join(parts), "k", 1))
    docs += [(7, "again item three with other words of its own for you", "k", 1)] * 2 + [(None, "and lone here", "k", 1), (500, None, "k", 1), (501, "", "k", 1), (502, "... !", "k", 1), (503, "x of " * 50, "k", 1), (504, "filler " * 200_000 + "again item three with other words of its own for you", "k", 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, key string, row int").repartition(6)
    out = decontaminate.digest(decontaminate.contaminated(df, spark.createDataFrame(items, "item_id long, text string")))
    want = plain_hits(docs, items, 10)
    assert sum(w[5] for w in want) > 20
    same_rows(out, want)


def test_decontamination_of_nothing(spark):
    df = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "some words")], "item_id long, text string")
    assert decontaminate.contaminated(df.where("false"), items).count() == 0
    assert decontaminate.digest(decontaminate.contaminated(df, items.where("false"))).first().n_hit == 0
    assert decontaminate.clean(decontaminate.contaminated(df, items)).count() == 0


def test_decontamination_is_native(spark, sf):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    plan = decontaminate.contaminated(docs, items)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_rarest_shingle_is_the_prefix(spark):
    """A window of a common passage and a rare word is searched by the rare one."""
    docs = spark.createDataFrame([(i, "a b c d e f g h i j") for i in range(20)] + [(99, "a b c d e f g h i rare")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f g h i rare")], "item_id long, text string")
    out = {r.doc_id: r.n_hit for r in decontaminate.contaminated(docs, items).collect()}
    assert out[99] == 10 and sum(out.values()) == 10


