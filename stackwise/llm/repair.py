"""Conversation structure repair: the cheapest edits that give (s?(ua)+)?, by a DP over retained turns.

A conversation's rows are in order of turn (nulls first), then of role, of the first 100 characters
of the text and of its SHA-256. A row is blank, a
duplicate (of an earlier role and text), truncated or sound; blank rows and duplicates must go. Retained are a
subsequence of the others, each kept (0) or reroled (2), with 1 more if truncated; every other row is deleted
(3). What stands between two retained turns costs the deletions between them, a difference of prefix sums, and
the inserts (2 each) that the pair of their roles needs. So the cheapest suffix of a retained turn and role is
found from the end, with a running minimum for each role of (prefix sum + suffix); its price in a gap is the minimum less
the prefix sum before the gap, and no pair of turns is looked at. Costs tie by the audit, the string of the edits' initials: in a
gap deletions come first, as D < I < K < R, so of equal costs the one with the later next turn is taken, then the one that
inserts, then the one that keeps.

Conversations of any length are spread: rows are range-sorted once, and numbered; ``SEGMENT`` consecutive
numbers are a segment, which one task holds as a few bytes a row. The pieces of a conversation that goes on in
another segment give a 4 x 4 table of costs, from the last retained role before them to the last one
in them; going backwards over these tables gives the costs that follow each segment, and with them every segment's
edits are found by itself, for each role that may come before. The last stage is a stream over each conversation's rows in order,
which applies the edits and feeds the text to SHA-256, row by row: that hash is a chain by definition, so a
conversation's text passes one task, which holds a row of it and the audit.
Equal rows are spread over the range partitions by their number; what is a duplicate is told by a partial aggregate.

Defined results: a null role or text is one space, so a null text is blank; a null turn is none (it
comes first and makes no gap); a null conv_id is a conversation; rows that repeat are duplicates; equal turns are in the
order above; an empty table gives no rows. Columns other than conv_id, turn, role and text are ignored, whatever they are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from stackwise.session import saved, ship

KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
#: Bits of a row's number inside a segment.
SEGMENT_BITS = 16
#: Rows of pieces that are worked on at a time.
BLOCK_ROWS = 40_000
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = (SYSTEM, USER, ASSISTANT)
NEVER = 1 << 40
SPACE = " \t\n\x0b\f\r"
#: Inserts between a retained role (or the start) and the next one.
BETWEEN = np.array([[NEVER, 0, 0, 1], [NEVER, NEVER, 0, 1], [NEVER, NEVER, 1, 0], [NEVER, NEVER, 0, 1]], np.int64)
#: Inserts after the last retained role.
CLOSING = np.array([0, 2, 1, 0], np.int64)
FAULTS = {"sound": 0, "blank": 1, "duplicate": 2, "truncated": 3}


# --- damage, as the query asks for it


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the stated faults by crc32 of conv_id:turn, modulo 20."""
    one_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(one_space("conv_id"), F.lit(":"), one_space("turn"))), F.lit(20))
    d = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), one_space("role").alias("role"), one_space("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return d.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")


# --- the DP


class Pieces:
    """Runs of rows, each of one conversation: codes (role's initial as a state, or 0), cut (truncated) and dead (to be deleted) one after the other."""

    def __init__(self, codes, cut, dead, sizes):
        self.codes, self.cut, self.dead, self.sizes = codes, cut, dead, np.asarray(sizes, np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes

    def solve(self, after: np.ndarray, choices: bool):
        """Costs, piece x end x state before, of piece and rest by ``after`` (piece x end x state: what follows the piece).

        With ``choices``, for one end: of each row (and of the place before each piece) and state, the next retained row
        (its distance) and role; distance 0 for none.
        """
        order = np.argsort(-self.sizes, kind="stable")
        begins, sizes, after = self.begins[order], self.sizes[order], after[order]
        n, ends = len(order), after.shape[1]
        longest = int(sizes[0]) if n else 0
        # running minima by role: deletions from the piece's end to the retained row, and its suffix
        best = np.full((n, ends, 4), 4 * NEVER, np.int64)
        where = np.zeros((n, ends, 4), np.int64)  # steps from the end
        out = np.empty((n, ends, 4), np.int64)
        total = int(self.sizes.sum())
        far, role = (np.zeros((total + n, 4), np.int32), np.zeros((total + n, 4), np.int8)) if choices else (None, None)

        def price(k: int, step: int, code=None):
            """Of the first k pieces, the cheapest way on after the row ``step`` steps before the end, by state."""
            gap = (DELETE * (step - 1)) + np.zeros(1, np.int64)
            cost = np.empty((k, ends, 4, 4), np.int64)  # state, next role (0: none)
            cost[..., 0] = DELETE * step + after[:k]
            for r in ROLES:
                cost[..., r] = gap + best[:k, :, None, r] + INSERT * BETWEEN[None, None, :, r]
            cost = np.minimum(cost, NEVER)
            least = cost.min(-1)
            if code is None:
                return least, None, None
            # ties: no further turn, else the later one, then an insert, then keeping rather than reroling
            rank = np.zeros((k, ends, 4, 4), np.int64)
            for r in ROLES:
                next_at = begins[:k, None] + sizes[:k, None] - where[:k, :, r]
                kept = self.codes[np.minimum(next_at, total - 1)] == r if total else np.zeros((k, ends), bool)
                how = np.where(BETWEEN[None, None, :, r] == 1, 0, np.where(kept[:, :, None], 1, 2))
                rank[..., r] = 1 + where[:k, :, None, r] * 4 + how
            rank[cost > least[..., None]] = np.iinfo(np.int64).max
            nxt = rank.argmin(-1)
            at = np.take_along_axis(np.broadcast_to(where[:k, :, None, :], (k, ends, 4, 4)), nxt[..., None], -1)[..., 0]
            return least, nxt, np.where(nxt == 0, 0, step - at + 1)

        active = np.searchsorted(-sizes, -np.arange(longest + 1), side="right")  # pieces of at least so many rows
        for step in range(longest + 1):
            # the row at this step from the end (0: the last), after what follows it is priced
            k = int(active[step])
            rows = begins[:k] + sizes[:k] - step - 1 if step < longest else None
            done = np.flatnonzero(sizes[:k] == step)
            least, nxt, distance = price(k, step, True if choices else None)
            if len(done):
                out[done] = least[done]
                if choices:
                    far[total + done], role[total + done] = distance[done, 0], nxt[done, 0]
            if step == longest:
                break
            m = int(active[step + 1])
            rows, least = rows[:m], least[:m]
            if choices:
                far[rows], role[rows] = distance[:m, 0], nxt[:m, 0]
            code, cut, dead = self.codes[rows], self.cut[rows], self.dead[rows]
            for r in ROLES:
                own = np.where(dead | ((r == SYSTEM) & (code != SYSTEM)), NEVER, np.where(code == r, KEEP, REROLE) + CUT * cut)
                # the deletions after the row are in ``least`` already; those before it come with the gap
                value = own[:, None] + least[:, :, r] - DELETE * step
                better = value < best[:m, :, r]
                best[:m, :, r] = np.where(better, value, best[:m, :, r])
                where[:m, :, r] = np.where(better, step + 1, where[:m, :, r])
        back = np.empty(n, np.int64)
        back[order] = np.arange(n)
        if choices:
            return out[back], far, role, total + back
        return out[back]

    def audits(self, after: np.ndarray, starts: list[list[int]]) -> list[dict[int, tuple[int, bytes]]]:
        """For each piece and each state before it: the last retained role, and the edits' initials."""
        _, far, role, first = self.solve(after[:, None, :], True)
        out = []
        for p, states in enumerate(starts):
            begin, size, ways = int(self.begins[p]), int(self.sizes[p]), {}
            for s in states:
                edits, state, at, entry = bytearray(), s, -1, int(first[p])
                while True:
                    step, r = int(far[entry, state]), int(role[entry, state])
                    if not r:
                        edits += b"D" * (size - 1 - at)
                        break
                    edits += b"D" * (step - 1) + b"I" * int(BETWEEN[state, r])
                    at += step
                    entry = begin + at
                    edits += b"K" if self.codes[entry] == r else b"R"
                    state = r
                ways[s] = state, bytes(edits)
            out.append(ways)
        return out


def pieces_of(batches: Iterator[pa.RecordBatch], rows: int = BLOCK_ROWS) -> Iterator[tuple]:
    """Blocks of whole pieces of a stream in order of segment and number: the rows' columns, where pieces begin, and their places (first and last) in their segments."""
    held: list[pa.RecordBatch] = []
    size = 0

    def cut(table: pa.Table, final: bool):
        seg = table["seg"].to_numpy()
        fresh = np.r_[True, (seg[1:] != seg[:-1])] if len(seg) else np.zeros(0, bool)
        begin = fresh | table["opens"].to_numpy(zero_copy_only=False)
        segments = np.flatnonzero(fresh)
        # the last segment may go on in the next batch
        upto = len(seg) if final else int(segments[-1]) if len(segments) else 0
        return table.slice(0, upto), begin[:upto], fresh[:upto], table.slice(upto)

    for b in batches:
        held.append(b)
        size += b.num_rows
        if size >= rows:
            block, begin, fresh, rest = cut(pa.Table.from_batches(held).combine_chunks(), False)
            if block.num_rows:
                yield block, begin, fresh
                held, size = rest.to_batches(), 0
    if held:
        block, begin, fresh, _ = cut(pa.Table.from_batches(held).combine_chunks(), True)
        if block.num_rows:
            yield block, begin, fresh


def _as_pieces(block: pa.Table, begin: np.ndarray, fresh: np.ndarray):
    starts = np.flatnonzero(begin)
    fault = block["fault"].to_numpy()
    own = Pieces(block["code"].to_numpy().astype(np.int64), (fault == FAULTS["truncated"]).astype(np.int64), (fault == FAULTS["blank"]) | (fault == FAULTS["duplicate"]), np.diff(np.r_[starts, len(begin)]))
    opens = fresh[starts]
    return own, starts, opens, np.r_[opens[1:], True]


# --- on Spark


def ordered(rows: DataFrame) -> DataFrame:
    """The rows range-sorted, with at, a gapless number in each range partition, code and what their own text shows."""
    r = rows.withColumn("copy", F.monotonically_increasing_id()).withColumn("key", F.sha2("text", 256)).withColumn("begin", F.substring("text", 1, 100))
    keys = ["conv_id", "turn", "role", "begin", "key", "copy"]
    r = r.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("begin", "copy").withColumn("at", F.monotonically_increasing_id())
    initial = F.substring("role", 1, 1)
    code = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(START)
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    own = F.when(bare == "", FAULTS["blank"]).when(~F.substring(bare, -1, 1).isin(".", "!", "?"), FAULTS["truncated"]).otherwise(FAULTS["sound"])
    return saved(r.withColumn("code", code.cast("byte")).withColumn("own", own.cast("byte")), "ordered")


def faults(rows: DataFrame, bits: int) -> DataFrame:
    """conv_id, seg, at, opens (the first row of its conversation), code, fault of every row."""
    first = rows.groupBy("conv_id", "role", "key").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    opening = rows.groupBy("conv_id").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("opens"))
    r = rows.select("conv_id", "at", "code", "own").join(first, "at", "left").join(opening, "at", "left")
    fault = F.when(F.col("own") == FAULTS["blank"], F.col("own")).when(F.col("first").isNull(), F.lit(FAULTS["duplicate"])).otherwise(F.col("own"))
    return saved(r.select("conv_id", F.shiftright("at", bits).alias("seg"), "at", F.coalesce("opens", F.lit(False)).alias("opens"), "code", fault.cast("byte").alias("fault")), "faults")


def by_segment(light: DataFrame) -> DataFrame:
    return light.repartition("seg").sortWithinPartitions("seg", "at")


def boundaries(light: DataFrame) -> DataFrame:
    """seg, head_after, tail_after: the costs that follow a segment's first and its last piece, by the last retained role."""
    kind = light.schema["conv_id"].dataType.simpleString()

    def tables(batches):
        for block, begin, fresh in pieces_of(batches):
            _, starts, opens, closes = _as_pieces(block, begin, fresh)
            # a piece inside a segment is a whole conversation
            edge = opens | closes
            rows = np.repeat(edge, np.diff(np.r_[starts, len(begin)]))
            block, begin, fresh, opens, closes = block.filter(pa.array(rows)).combine_chunks(), begin[rows], fresh[rows], opens[edge], closes[edge]
            own, starts, _, _ = _as_pieces(block, begin, fresh)
            costs = own.solve(np.where(np.eye(4, dtype=bool), 0, NEVER)[None].repeat(len(starts), 0), False)
            at = pa.array(starts)
            columns = [block["conv_id"].combine_chunks().take(at), block["seg"].combine_chunks().take(at), block["at"].combine_chunks().take(at), pa.array(opens), pa.array(closes), pa.array([c.ravel() for c in costs], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "seg", "at", "head", "tail", "costs"])

    edges = by_segment(light).mapInArrow(tables, f"conv_id {kind}, seg long, at long, head boolean, tail boolean, costs array<long>")

    def follow(batches):
        """Over each conversation's pieces from the last to the first: what follows each."""
        conv, after, seen = None, CLOSING * INSERT, False
        for b in batches:
            out = []
            for c, costs in zip(b.column("conv_id").to_pylist(), b.column("costs").to_pylist()):
                if not seen or c != conv:
                    conv, after, seen = c, CLOSING * INSERT, True
                out.append(after)
                after = np.minimum((np.array(costs, np.int64).reshape(4, 4) + after[:, None]).min(0), NEVER)
            yield pa.RecordBatch.from_arrays([b.column("seg"), b.column("head"), b.column("tail"), pa.array(out, pa.list_(pa.int64()))], names=["seg", "head", "tail", "after"])

    pieces = edges.repartition("conv_id").sortWithinPartitions(F.col("conv_id"), F.col("at").desc())
    found = pieces.select("seg", "head", "tail", "conv_id", "costs").mapInArrow(follow, "seg long, head boolean, tail boolean, after array<long>")
    return saved(found.groupBy("seg").agg(F.max(F.when(F.col("head"), F.col("after"))).alias("head_after"), F.max(F.when(F.col("tail"), F.col("after"))).alias("tail_after")), "boundaries")


def edits(light: DataFrame, bounds: DataFrame) -> DataFrame:
    """conv_id, at (of a piece's first row), faults (a byte a row), ways (array<struct<before, last, audit>>) of every piece."""

    def run(batches):
        for block, begin, fresh in pieces_of(batches):
            own, starts, opens, closes = _as_pieces(block, begin, fresh)
            after = np.tile(CLOSING * INSERT, (len(starts), 1))
            first = block["opens"].to_numpy(zero_copy_only=False)[starts]
            for name, edge in (("head_after", opens), ("tail_after", closes)):
                for p in np.flatnonzero(edge):
                    given = block[name][int(starts[p])].as_py()
                    after[p] = given if given is not None else after[p]
            found = own.audits(after, [[START] if f else [0, 1, 2, 3] for f in first])
            fault = block["fault"].to_numpy().astype(np.uint8)
            ends = np.r_[starts[1:], len(begin)]
            yield pa.RecordBatch.from_arrays(
                [block["conv_id"].combine_chunks().take(pa.array(starts)), pa.array(block["at"].to_numpy()[starts]), pa.array([fault[a:e].tobytes() for a, e in zip(starts, ends)], pa.binary()), pa.array([[{"before": s, "last": r, "audit": a.decode()} for s, (r, a) in w.items()] for w in found], pa.list_(pa.struct([("before", pa.int32()), ("last", pa.int32()), ("audit", pa.string())])))],
                names=["conv_id", "at", "faults", "ways"],
            )

    joined = by_segment(light.join(bounds, "seg", "left"))
    return saved(joined.mapInArrow(run, f"conv_id {light.schema['conv_id'].dataType.simpleString()}, at long, faults binary, ways array<struct<before int, last int, audit string>>"), "edits")


RESULT = "conv_id {0}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class Conversation:
    """One conversation's rows in order, as they come; holds its audit and counts, and a hash of what is repaired."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.hash, self.lines, self.audit = hashlib.sha256(), 0, []
        self.faults = [0, 0, 0, 0]
        self.illegal = self.cost = 0
        self.state, self.ops, self.next = START, "", 0
        self.flags, self.row = b"", 0
        self.initial = None
        self.low = self.high = None
        self.turns = 0

    def line(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
        self.lines += 1

    def insert(self) -> None:
        self.out = USER if self.out != USER else ASSISTANT
        self.line("user" if self.out == USER else "assistant", "")
        self.cost += INSERT

    def piece(self, faults: bytes, ways: list[dict]) -> None:
        way = next(w for w in ways if w["before"] == self.state)
        self.out, self.state = self.state, way["last"]
        self.ops, self.next, self.flags, self.row = way["audit"], 0, faults, 0
        self.audit.append(way["audit"])

    def turn(self, turn: int | None, role: str, text: str) -> None:
        fault = self.flags[self.row]
        self.row += 1
        self.faults[fault] += 1
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = initial
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high, self.turns = turn, self.turns + 1
        while self.ops[self.next] == "I":
            self.insert()
            self.next += 1
        op = self.ops[self.next]
        self.next += 1
        if op == "D":
            self.cost += DELETE
            return
        self.cost += (REROLE if op == "R" else KEEP) + CUT * (fault == FAULTS["truncated"])
        if op == "R":
            self.out = USER if self.out != USER else ASSISTANT
            role = "user" if self.out == USER else "assistant"
        else:
            self.out = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[initial]
        self.line(role, text)

    def result(self) -> tuple:
        closing = int(CLOSING[self.state])
        if closing:
            self.audit.append("I" * closing)
            self.out = self.state
            for _ in range(closing):
                self.insert()
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return (self.conv_id, gaps, *self.faults[1:], self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest())


def applied(rows: DataFrame, found: DataFrame, every: DataFrame) -> DataFrame:
    """One row a conversation of ``every``: its faults, and its repair."""
    kind = rows.schema["conv_id"].dataType
    none = lambda name, t: F.lit(None).cast(t).alias(name)
    ways = "array<struct<before int, last int, audit string>>"
    own = found.select("conv_id", "at", F.lit(0).alias("part"), none("turn", "long"), none("role", "string"), none("text", "string"), "faults", "ways")
    texts = rows.select("conv_id", "at", F.lit(1).alias("part"), "turn", "role", "text", none("faults", "binary"), none("ways", ways))
    anchors = every.select("conv_id", F.lit(-1).cast("long").alias("at"), F.lit(-1).alias("part"), none("turn", "long"), none("role", "string"), none("text", "string"), none("faults", "binary"), none("ways", ways))
    stream = anchors.unionByName(own).unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", "at", "part")
    names = [f.split()[0] for f in RESULT.split(", ")]

    def run(batches):
        current = None
        for b in batches:
            done = []
            cols = [b.column(i) for i in range(b.num_columns)]
            for conv, part, turn, role, text, flags, way in zip(cols[0].to_pylist(), cols[2].to_pylist(), cols[3].to_pylist(), cols[4].to_pylist(), cols[5].to_pylist(), cols[6].to_pylist(), cols[7].to_pylist()):
                if part < 0:
                    if current is not None:
                        done.append(current.result())
                    current = Conversation(conv)
                elif part == 0:
                    current.piece(flags, way)
                else:
                    current.turn(turn, role, text)
            if done:
                yield _batch(done, cols[0].type, names)
        if current is not None:
            yield _batch([current.result()], cols[0].type, names)

    return stream.mapInArrow(run, RESULT.format(kind.simpleString()))


def _batch(rows: list[tuple], kind: pa.DataType, names: list[str]) -> pa.RecordBatch:
    types = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def repaired(rows: DataFrame, every: DataFrame | None = None, segment_bits: int = SEGMENT_BITS) -> DataFrame:
    """Repair of ``rows`` (conv_id, turn, role, text): a row for each conversation of ``every`` (by default of ``rows``)."""
    ship(rows.sparkSession)
    every = (rows if every is None else every).select("conv_id").distinct()
    r = ordered(rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text")))
    light = faults(r, segment_bits)
    return applied(r, edits(light, boundaries(light)), every)
