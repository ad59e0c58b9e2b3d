"""Mixture-controlled packing: deficit round-robin over source queues, spread over lanes.

A source's queue is in order of a hash of the row, cut in parts of equal hash ranges whose tokens
are summed up; inside a part it is in order of another hash, and a document's place in the queue is
the tokens before its part and its share of the part's. The round that serves a place is the place over the
source's quantum, and lanes are ranges of rounds of about equal tokens: with the proportions that there are,
equal shares of all queues. So no source, however large, meets in one task; with other proportions a queue
that its share serves fast lies in the first lanes only, as in one long round-robin.
A lane may be many parts or a small piece of one: there is one rule for all sizes. The hash of a row
is one of its id, source and token ids. Rows that are equal in all of these (a third of all may be)
lie in one part, which is spread over as many lanes as its tokens fill, by their number in the
written table of tokens.
A round serves one window: every source earns quantum = window * share tokens of credit and
sends documents while its credit lasts. What a source has earned but not sent (its deficit) is
carried from window to window, and from lane to lane: a lane starts with
share * (credit of all rounds before it) - (the source's tokens in earlier lanes). While all queues last
that credit is the tokens in earlier lanes; later rounds serve fewer queues, so more of them fill a window.
The lanes' streams follow each other without a gap, windows are cut from the whole stream, so
at most the last window of all needs padding.

Defined results: null or empty text packs as the end token alone; null source is a queue of
its own; null ids stay null; repeated rows are packed one by one; a text longer than a window, or
than a lane, is cut into as many pieces as it takes; an empty table gives no pieces. Columns other
than doc_id, source and text are ignored, whatever they are called.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from stackwise.llm.common import WordCache
from stackwise.session import saved, ship

END_ID = 1
#: Tokens of a lane: what one task holds at a time (2 bytes a token).
LANE_TOKENS = 1_000_000
#: Parts that each source's queue is cut in, and how many of all sources are at most broadcast (some 10 MB); more are joined by a shuffle.
PARTS = 4096
MOST_BROADCAST = 131_072
#: Lanes of a group in the two-level running sums.
LANE_GROUP = 256
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_encoders: dict[str, "WordEncoder"] = {}


class WordEncoder:
    """Token ids of whole texts (uint32 bytes) by a tokenizer that drops white space, so that words encode alone."""

    #: Python splits at these, the tokenizer's white space has them not: such texts are encoded as they are.
    ODD = re.compile("[\x1c-\x1f]")
    #: No apostrophe and no < (contractions and special tokens cross the parts), and letters whose lower case is one letter.
    PLAIN = re.compile(r"[\t-\r !-&(-;=-~À-ÖØ-öø-įı-ſ]*\Z")
    PART = re.compile(r"[a-zß-öø-ÿā-ſ]+|[0-9]|[^\t-\r a-zß-öø-ÿā-ſ0-9]+")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # bytes as the characters that the vocabulary has for them: those that do not print are counted up from 256
        odd = [b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE)]
        self.bytes = {b: 256 + i for i, b in enumerate(odd)}
        self.parts = WordCache(self.part, 300_000)
        self.words = WordCache(self.word, 100_000)

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def part(self, part: str) -> bytes:
        """One part, by the vocabulary's merges alone."""
        text = part if part.isascii() else part.encode().decode("latin-1").translate(self.bytes)
        return np.array([t.id for t in self.tokenizer.model.tokenize(text)], dtype="<u4").tobytes()

    def plain(self, text: str) -> bytes:
        """Plain Latin text by its parts: lower-cased runs of letters, digits, and runs of other characters."""
        return b"".join(map(self.parts.__getitem__, self.PART.findall(text.lower())))

    def word(self, word: str) -> bytes:
        return self.plain(word) if self.PLAIN.match(word) else self.encode(word)

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.PLAIN.match(text):
            return self.plain(text)
        if self.ODD.search(text):
            return self.encode(text)
        return b"".join(map(self.words.__getitem__, text.split()))


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def tokenized(df: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, source, row (a number of the row), n (tokens with the end token) and ids (uint16 or uint32 bytes, the width in ``wide``)."""
    ship(df.sparkSession)
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        enc = encoder(tokenizer_path)
        for b in batches:
            ids, n, wide = [], [], []
            for t in b.column(3).to_pylist():
                raw = enc.ids(t) + end
                a = np.frombuffer(raw, "<u4")
                n.append(len(a))
                wide.append(bool(a.max() > 0xFFFF))
                ids.append(raw if wide[-1] else a.astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(n, pa.int64()), pa.array(wide, pa.bool_()), pa.array(ids, pa.binary())], names=["doc_id", "source", "row", "n", "wide", "ids"])

    return df.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.monotonically_increasing_id().alias("row"), "text").mapInArrow(run, "doc_id long, source string, row long, n long, wide boolean, ids binary")


def deal(docs: pa.Table, state: pa.Table, window: int) -> pa.Table:
    """Pieces of one lane. docs: doc_id, source, n, wide, ids in queue order; state: source, before, lane_before, credit, share."""
    codes = {s: i for i, s in enumerate(state["source"].to_pylist())}
    src = np.array([codes[s] for s in docs["source"].to_pylist()], dtype=np.int64)
    n = docs["n"].to_numpy().astype(np.int64)
    share = state["share"].to_numpy().astype(float)
    lane_before = state["lane_before"][0].as_py()
    carried = share * state["credit"][0].as_py() - state["before"].to_numpy().astype(float)
    order = np.argsort(src, kind="stable")
    s, m = src[order], n[order]
    total = np.cumsum(m)
    first = np.r_[True, s[1:] != s[:-1]]
    sent = total - np.maximum.accumulate(np.where(first, total - m, 0))
    # a document goes in the first round by which its source's credit covers all it has sent with it
    turn = np.maximum(1, np.ceil((sent - carried[s]) / (window * np.maximum(share[s], 1e-12))))
    placed = order[np.lexsort((np.arange(len(s)), s, turn))]
    begin = lane_before + np.cumsum(n[placed]) - n[placed]
    ids, wide, doc_id = docs["ids"].to_pylist(), docs["wide"].to_pylist(), docs["doc_id"].to_pylist()
    cols: list[list] = [[] for _ in range(7)]
    for i, g in zip(placed.tolist(), begin.tolist()):
        raw = np.frombuffer(ids[i], "<u4" if wide[i] else "<u2").astype("<u4").tobytes()
        size, at = len(raw) // 4, 0
        while at < size:
            sequence, offset = divmod(g + at, window)
            length = min(window - offset, size - at)
            for c, v in zip(cols, (doc_id[i], at, length, zlib.crc32(raw[4 * at : 4 * (at + length)]), size, sequence, offset)):
                c.append(v)
            at += length
    return pa.table([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


def _running(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """Sum of ``value`` over earlier lanes, in two levels so that no window holds more than the lane groups."""
    grouped = df.withColumn("g", F.floor(F.col("lane") / LANE_GROUP))
    above = grouped.groupBy(*by, "g").agg(F.sum(value).alias("v")).withColumn("above", F.coalesce(F.sum("v").over(Window.partitionBy(*(by or [F.lit(0)])).orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("v")
    keys = [*by, "g"]
    a, b = grouped.alias("a"), above.alias("b")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    within = a.join(b, on, "inner").select("a.*", "b.above")
    return within.withColumn(name, F.col("above") + F.coalesce(F.sum(value).over(Window.partitionBy(*keys).orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("above", "g")


#: Rounds at which the tokens served so far are counted exactly; between them they are interpolated.
KNOTS = 64


def served(sources: DataFrame) -> tuple[list[float], list[float]]:
    """Knots of the tokens that a round-robin over sources (share, tokens) has served, by the credit of all rounds so far.

    A queue is served by share * credit until it is empty. The knots are quantiles of the credits at which queues end.
    """
    ends = sources.select("tokens", "share", (F.col("tokens") / F.col("share")).alias("end"))
    found = ends.agg(F.percentile_approx("end", [i / KNOTS for i in range(1, KNOTS + 1)], 10_000).alias("q"), F.max("end").alias("last")).first()
    if not found["q"]:
        return [0.0, 1.0], [0.0, 0.0]
    at = sorted({*found["q"], found["last"]})
    sums = ends.agg(*[F.sum(F.least(F.col("tokens").cast("double"), F.col("share") * F.lit(float(c)))).alias(f"k{i}") for i, c in enumerate(at)]).first()
    return [0.0, *at], [0.0, *sums]


def interpolated(x: Column, xs: list[float], ys: list[float]) -> Column:
    """The line through the knots; beyond the last one its value."""
    out = F.lit(ys[-1])
    for i in range(len(xs) - 1, 0, -1):
        slope = (ys[i] - ys[i - 1]) / (xs[i] - xs[i - 1]) if xs[i] > xs[i - 1] else 0.0
        out = F.when(x < F.lit(xs[i]), F.lit(ys[i - 1]) + (x - F.lit(xs[i - 1])) * F.lit(slope)).otherwise(out)
    return out


def pack(df: DataFrame, tokenizer_path: str, window: int = 2048, shares: Column | None = None, lane_tokens: int = LANE_TOKENS) -> DataFrame:
    """Every document of ``df`` (doc_id, source, text), cut into pieces of windows of ``window`` tokens.

    ``shares`` (of the columns source and tokens, by source; over 0) gives target proportions; by default the
    proportions of the tokens there are, so that every queue lasts to the end. Where a queue ends before, the
    others go on in their proportions.
    """
    ship(df.sparkSession)
    tok = saved(tokenized(df, tokenizer_path), "tokens")
    # 52 bits of a hash as a fraction of 1
    fraction = lambda h: F.shiftrightunsigned(h, 12) / F.lit(float(1 << 52))
    tok = tok.withColumn("h", F.xxhash64("doc_id", "source", F.crc32("ids")))
    part = F.floor(fraction(F.col("h")) * PARTS).cast("int")
    parts = saved(tok.groupBy("source", part.alias("part")).agg(F.sum("n").alias("tokens")), "parts")
    total, n_parts = parts.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.count("*")).first()
    lanes = max(1, -(-total // lane_tokens))
    queue = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    place = parts.select("source", "part", "tokens", F.coalesce(F.sum("tokens").over(queue), F.lit(0)).alias("above"), F.sum("tokens").over(Window.partitionBy("source")).alias("of"))
    place = F.broadcast(place) if n_parts <= MOST_BROADCAST else place
    t, p = tok.withColumn("part", part).withColumn("within", fraction(F.xxhash64("row"))).alias("t"), place.alias("p")
    if shares is None:
        xs = ys = None
        at = (F.col("p.above") + F.col("t.within") * F.col("p.tokens")) / F.col("p.of")
    else:
        given = saved(parts.groupBy("source").agg(F.sum("tokens").alias("tokens")).select("source", "tokens", F.greatest(F.lit(1e-9), shares.cast("double")).alias("share")), "shares")
        xs, ys = served(given)
        by = given.select("source", "share").alias("g")
        p = p.join(by, F.col("p.source").eqNullSafe(F.col("g.source"))).select("p.*", "g.share").alias("p")
        credit = (F.col("p.above") + F.col("t.within") * F.col("p.tokens")) / F.col("p.share")
        at = interpolated(credit, xs, ys) / F.lit(float(max(total, 1)))
    tok = t.join(p, F.col("t.source").eqNullSafe(F.col("p.source")) & (F.col("t.part") == F.col("p.part"))).select("t.doc_id", "t.source", "t.n", "t.wide", "t.ids", "t.h", F.least(F.lit(lanes - 1), F.floor(at * lanes)).cast("long").alias("lane"))
    per = saved(tok.groupBy("lane", "source").agg(F.sum("n").alias("tokens")), "lanes")
    by_source = per.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    by_source = by_source.select("source", (F.col("tokens") / F.lit(float(max(total, 1)))).cast("double").alias("share")) if shares is None else given.select("source", "share")
    before = _running(per, ["source"], "tokens", "before")
    lane_before = _running(per.groupBy("lane").agg(F.sum("tokens").alias("t")), [], "t", "lane_before").drop("t")
    state = before.alias("p").join(by_source.alias("s"), F.col("p.source").eqNullSafe(F.col("s.source"))).select("p.*", "s.share").join(lane_before, "lane")
    credit = F.col("lane_before").cast("double") if shares is None else interpolated(F.col("lane_before").cast("double"), ys, xs)
    state = state.select("lane", "source", "before", "lane_before", credit.alias("credit"), "share")

    def run(docs: pa.Table, lane_state: pa.Table) -> pa.Table:
        docs = docs.sort_by([("h", "ascending"), ("doc_id", "ascending"), ("n", "ascending"), ("source", "ascending"), ("ids", "ascending")])
        return deal(docs, lane_state.sort_by([("source", "ascending")]), window)

    return tok.groupBy("lane").cogroup(state.groupBy("lane")).applyInArrow(run, PIECE)
