"""Near-duplicate detection on SimHash fingerprints with vantage-point trees.

Fingerprints. A text's words (A-Z lower-cased) give shingles; every bit of a fingerprint is set
if it is set in more than half of the shingles' hashes. Bits beyond 64 come from remixing the
shingle's XXH64. Equal fingerprints form a class, named by its smallest id.

Exact pairs within a radius. If the fingerprint is cut into m pieces, two fingerprints at
distance d differ in at most floor(d / m) bits of some piece. So each piece has a vantage-point
tree whose metric is the Hamming distance on that piece alone, with that smaller radius: there
its triangle bounds prune well, where on all 64 bits they would not (distances to any point
crowd around half the bits). A node has a vantage point and a bound; a fingerprint's home is
inside or outside it. One that is outside by no more than the radius also visits the inside
(the reverse is not needed: each pair has to meet once). Leaves are shards; a task compares a
shard's homes with each other and with its visitors, on all bits. Trees are built on the
driver from a bounded sample; they decide only where pairs meet, not which pairs there are. Leaves
that are overfull, as the sample is too small for the table, are cut by trees of their own, each
built in a task from a bounded sample of its leaf, level by level; so leaves do not grow with the
table. What no tree can cut (equal pieces) is dealt to tasks in parts.

The pipeline's near copies (``deduplicated``) meet in such trees over the first 64 bits of their fingerprints,
which find all pairs within the radius. Copies of a similarity of 0.8 may lie further apart than any tree
on 64 bits can prune, so every set of shingles has bands of MinHash values too, and sets with an equal band meet as well. Whether
two sets share a band depends on their similarity alone, and not on how many documents there are. All of these
are candidates; links are verified by the sets themselves.

Inside a shard, a fingerprint with many neighbours is a vantage point again: its neighbours
are joined to it at once, and are compared only with those within twice the radius. So groups of
near copies cost their size, not its square. Links leave a task as a spanning star.

Defined results: null text counts as empty; texts without words have fingerprint zero and
link like any other; a null id has a fingerprint, and takes no part in links (null component);
repeated rows are of one class; an empty table gives no rows; of a long text all shingles are
hashed at once (eight bytes each). ``detect`` ignores columns other than doc_id and text, whatever
they are called; ``deduplicated`` keeps them.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stackwise.llm.components import components
from stackwise.llm.shards import Unions, dealt
from stackwise.session import saved, ship

SEED = 42
#: The bound of the sample that trees are built from.
SAMPLE = 8192
_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Scheme:
    """words of a shingle; bits of a fingerprint; pairs at most ``radius`` bits apart; ``pieces`` trees, each with ``piece_radius``; fingerprints of a leaf."""

    words: int
    bits: int
    radius: int
    pieces: int
    piece_radius: int
    leaf: int


#: Exact: of two halves, one differs in at most 1 of 3 bits.
CONTRACT = Scheme(words=3, bits=64, radius=3, pieces=2, piece_radius=1, leaf=4096)


@dataclass(frozen=True)
class Copies:
    """words of a shingle; the least Jaccard ``similarity`` of copies; bits of a set's fingerprint; candidates at most ``radius`` bits apart; ``bands`` of ``rows`` MinHash values each; ``trees`` over the first bits."""

    words: int
    similarity: float
    bits: int
    radius: int
    bands: int
    rows: int
    trees: Scheme = Scheme(words=5, bits=64, radius=3, pieces=2, piece_radius=1, leaf=4096)


#: Jaccard similarity of 0.8 of five-word shingles is a cosine of 0.89, at which 77.5 of 512 bits differ on
#: average, with a standard deviation of 8; the radius adds 6 of those (and 3.6 where four of five shingles
#: are common, with 96 bits on average). At that similarity two sets share none of 24 bands of 4 with a
#: probability of (1 - 0.8 ** 4) ** 24, 3 in a million.
PIPELINE = Copies(words=5, similarity=0.8, bits=512, radius=128, bands=24, rows=4)
#: Rows, of a band that many sets share, that a task compares at a time; and of a group whose sets are compared, and shingles in them.
MOST_ROWS = 4096
MOST_SETS = 1024
MOST_SHINGLES = 4_000_000


def shingle_hashes(text: str, words: int) -> bytes:
    """XXH64 of every shingle, big-endian, one after the other."""
    from xxhash import xxh64_digest

    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return b""
    whole = b" ".join(w)
    if len(w) <= words:
        return xxh64_digest(whole, SEED)
    ends = list(accumulate(map(len, w)))
    ends = [e + i for i, e in enumerate(ends)]
    starts = [0] + [e + 1 for e in ends]
    return b"".join([xxh64_digest(whole[a:b], SEED) for a, b in zip(starts, ends[words - 1 :])])


def set_bits(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """[run, 64] counts of set bits, bit 0 first, over the runs of ``h`` that begin at ``starts``."""
    sizes = np.diff(np.r_[starts, len(h)])
    # eight byte counters in a word hold 255 rows
    parts = -(-sizes // 255)
    first = np.cumsum(parts) - parts
    inner = np.arange(parts.sum()) - np.repeat(first, parts)
    at = np.repeat(starts, parts) + 255 * inner
    out = np.empty((len(starts), 64), dtype=np.int64)
    for k in range(8):
        lanes = np.add.reduceat((h >> np.uint64(k)) & np.uint64(0x0101010101010101), at)
        out[:, k::8] = np.add.reduceat(lanes.astype("<u8").view(np.uint8).reshape(-1, 8), first, axis=0, dtype=np.int64)
    return out


def majority(h: np.ndarray, n: np.ndarray, bits: int) -> np.ndarray:
    """Fingerprints, a row of bytes each, of the runs of ``n`` hashes in ``h``."""
    starts = np.cumsum(n) - n
    packed = np.empty((len(n), bits // 8), dtype=np.uint8)
    for j in range(bits // 64):
        if j:
            g = h + np.uint64(j * _MIX[2] & (1 << 64) - 1)
            g = (g ^ (g >> np.uint64(30))) * np.uint64(_MIX[0])
            g = (g ^ (g >> np.uint64(27))) * np.uint64(_MIX[1])
            g ^= g >> np.uint64(31)
        else:
            g = h
        on = 2 * set_bits(g, starts) > n[:, None]
        packed[:, 8 * j : 8 * j + 8] = np.packbits(on[:, ::-1], axis=1)
    return packed


def fingerprints(texts: list[str], words: int, bits: int) -> list[bytes]:
    out = [bytes(bits // 8)] * len(texts)
    done, some, raw, size = 0, [], [], 0

    def flush() -> None:
        if not some:
            return
        h = np.frombuffer(b"".join(raw), dtype=">u8").astype(np.uint64)
        for i, p in zip(some, majority(h, np.array([len(r) // 8 for r in raw]), bits)):
            out[i] = p.tobytes()
        some.clear(), raw.clear()

    for i, t in enumerate(texts):
        r = shingle_hashes(t, words)
        if r:
            some.append(i), raw.append(r)
            size += len(r)
            if size > 2_000_000:
                flush()
                size = 0
    flush()
    return out


def with_fingerprints(df: DataFrame, scheme: Scheme, id_col: str = "doc_id") -> DataFrame:
    """id, fp (binary)."""
    ship(df.sparkSession)
    words, bits = scheme.words, scheme.bits

    def run(batches):
        for b in batches:
            fp = fingerprints([t or "" for t in b.column(1).to_pylist()], words, bits)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.binary())], names=["id", "fp"])

    return df.select(F.col(id_col).cast("long").alias("id"), "text").mapInArrow(run, "id long, fp binary")


def words_of(fps: list[bytes]) -> np.ndarray:
    """[fingerprint, word] as unsigned 64-bit numbers."""
    width = len(fps[0]) // 8 if fps else 1
    return np.frombuffer(b"".join(fps), dtype=">u8").astype(np.uint64).reshape(-1, width)


def piece_of(x: np.ndarray, scheme: Scheme, piece: int) -> np.ndarray:
    """The bits of one piece; pieces do not cross 64-bit words."""
    size = scheme.bits // scheme.pieces
    word, place = divmod(piece * size, 64)
    return (x[:, word] >> np.uint64(64 - place - size)) & np.uint64((1 << size) - 1)


class Tree:
    """Inner nodes are (vantage point, bound, inside, outside), leaves are numbers, counted from the inside out."""

    def __init__(self, sample: np.ndarray, radius: int, bits: int, leaf: float, seed: int):
        self.radius, self.bits, self.leaf, self.leaves = radius, bits, leaf, 0
        self.rng = np.random.default_rng(seed)
        self.root = self.grown(sample, 0)

    def grown(self, x: np.ndarray, depth: int):
        n = len(x)
        split = self.split(x) if n > max(self.leaf, 4) and depth < 40 else None
        if split is None:
            self.leaves += 1
            return self.leaves - 1
        point, bound = split
        d = np.bitwise_count(x ^ point)
        return point, bound, self.grown(x[d <= bound], depth + 1), self.grown(x[d > bound], depth + 1)

    def split(self, x: np.ndarray):
        """The vantage point and bound that leave the fewest comparisons, if they save a tenth."""
        n, best = len(x), None
        points = [*x[self.rng.integers(0, n, 6)], *self.rng.integers(0, 1 << self.bits, 6, dtype=np.uint64)]
        for p in points:
            per = np.bincount(np.bitwise_count(x ^ p), minlength=self.bits + self.radius + 2)
            inside = np.cumsum(per)
            for bound in range(self.bits):
                a = inside[bound]
                if 0 < a < n:
                    visits = inside[min(bound + self.radius, len(per) - 1)] - a
                    cost = a * a / 2 + a * visits + (n - a) ** 2 / 2
                    if best is None or cost < best[0]:
                        best = cost, p, bound
        return None if best is None or best[0] > 0.9 * n * n / 2 else best[1:]

    def places(self, x: np.ndarray, at_home: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, leaves and whether the row is at home there; rows that are not ``at_home`` in the tree are visitors everywhere."""
        rows, leaves, home = [], [], []
        at_home = np.ones(len(x), bool) if at_home is None else at_home
        stack = [(self.root, np.flatnonzero(at_home), np.flatnonzero(~at_home))]
        while stack:
            node, own, guests = stack.pop()
            if not len(own) and not len(guests):
                continue
            if not isinstance(node, tuple):
                rows += [own, guests]
                leaves.append(np.full(len(own) + len(guests), node))
                home += [np.ones(len(own), bool), np.zeros(len(guests), bool)]
                continue
            point, bound, inner, outer = node
            d, g = np.bitwise_count(x[own] ^ point).astype(int), np.bitwise_count(x[guests] ^ point).astype(int)
            stack.append((inner, own[d <= bound], np.concatenate([guests[g - self.radius <= bound], own[(d > bound) & (d - self.radius <= bound)]])))
            stack.append((outer, own[d > bound], guests[g + self.radius > bound]))
        if not rows:
            return np.zeros(0, int), np.zeros(0, int), np.zeros(0, bool)
        return np.concatenate(rows), np.concatenate(leaves), np.concatenate(home)


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """[row of a, row of b] bits that differ."""
    d = np.bitwise_count(a[:, 0, None] ^ b[None, :, 0]).astype(np.uint16)
    for w in range(1, a.shape[1]):
        d += np.bitwise_count(a[:, w, None] ^ b[None, :, w])
    return d


def linked(x: np.ndarray, homes: int, radius: int, cross: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges of the links that touch one of the first ``homes`` rows of x; ``cross``: only those to the other rows."""
    union = Unions(len(x))
    alive = np.arange(homes)
    guests = np.arange(homes, len(x))

    def compare(a: np.ndarray, b: np.ndarray) -> None:
        step = max(1, 2_000_000 // max(1, len(b)))
        for i in range(0, len(a), step):
            p, q = np.nonzero(apart(x[a[i : i + step]], x[b]) <= radius)
            union.merge(a[i + p], b[q])

    while len(alive) > 256 and not cross:
        tries = alive[np.linspace(0, len(alive) - 1, 8).astype(int)]
        balls = (apart(x[tries], x[alive]) <= radius).sum(1)
        if balls.max() < max(16, len(alive) // 64):
            break
        centre = tries[balls.argmax()]
        rest = np.concatenate([alive, guests])
        d = apart(x[centre : centre + 1], x[rest])[0]
        near = rest[d <= radius]
        union.merge(np.full(len(near), centre), near)
        ball = near[near < homes]
        compare(ball, rest[(d > radius) & (d <= 2 * radius)])
        alive = alive[d[: len(alive)] > radius]
    for i in range(0, len(alive), 512):
        compare(alive[i : i + 512], guests if cross else np.concatenate([alive[i:], guests]))
    return union.edges()


#: Leaves of so many times the rows they should have are cut again; rows of such a leaf that a task cuts at a time.
OVERFULL = 4
CUT_ROWS = 200_000
PLACES = "shard long, piece int, home boolean, id long, fp binary"


def placed(tree: Tree, above: int, piece: int, ids: pa.Array, fps: pa.Array, at_home: np.ndarray | None, scheme: Scheme) -> pa.RecordBatch:
    """The rows in the leaves of a tree below the shard ``above``; leaves are named by a hash of the shard and their number."""
    rows, leaves, home = tree.places(piece_of(words_of(fps.to_pylist()), scheme, piece), at_home)
    base = np.uint64(((above & (1 << 64) - 1) ^ _MIX[2]) * _MIX[0] & (1 << 64) - 1)
    name = base + leaves.astype(np.uint64) * np.uint64(_MIX[1])
    name = (name ^ (name >> np.uint64(29))) * np.uint64(_MIX[0])
    at = pa.array(rows)
    return pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(np.full(len(rows), piece, np.int32)), pa.array(home), ids.take(at), fps.take(at)], names=["shard", "piece", "home", "id", "fp"])


def finer(assigned: DataFrame, scheme: Scheme, sample: int) -> DataFrame:
    """``assigned`` with every overfull shard cut by a tree of its own, again and again, as long as that helps."""
    done, left = [], assigned

    def build(t: pa.Table) -> pa.Table:
        n, piece = t["h"][0].as_py(), t["piece"][0].as_py()
        x = piece_of(words_of(sorted(t["fp"].to_pylist())), scheme, piece)
        tree = Tree(x, scheme.piece_radius, scheme.bits // scheme.pieces, scheme.leaf * len(x) / n, piece)
        return pa.table([t["shard"][:1], pa.array([tree.leaves], pa.int32()), pa.array([pickle.dumps(tree)], pa.binary())], names=["shard", "leaves", "tree"])

    def cut(rows: pa.Table, trees: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        b = placed(pickle.loads(trees["tree"][0].as_py()), rows["shard"][0].as_py(), rows["piece"][0].as_py(), rows["id"].combine_chunks(), rows["fp"].combine_chunks(), rows["home"].to_numpy(zero_copy_only=False), scheme) if len(rows) else None
        return pa.Table.from_batches([b]) if b is not None else rows.select(["shard", "piece", "home", "id", "fp"])

    while True:
        counts = saved(left.groupBy("shard").agg(F.count_if("home").alias("h"), F.count("*").alias("m")).where(F.col("h") > OVERFULL * scheme.leaf), "overfull")
        if counts.isEmpty():
            break
        scale = 1 << 30
        seen = left.where("home").join(counts, "shard").where(F.pmod(F.xxhash64("fp"), F.lit(scale)) < F.lit(float(scale) * sample) / F.col("h"))
        trees = saved(seen.select("shard", "piece", "h", "fp").groupBy("shard").applyInArrow(build, "shard long, leaves int, tree binary").where("leaves > 1"), "trees")
        if trees.isEmpty():
            break
        parts = trees.join(counts, "shard").select("shard", "tree", F.ceil(F.col("m") / CUT_ROWS).cast("int").alias("parts"))
        done.append(left.join(trees.select("shard"), "shard", "left_anti"))
        rows = left.join(parts.select("shard", "parts"), "shard").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")
        spread = parts.select("shard", "tree", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        left = saved(rows.groupBy("shard", "part").cogroup(spread.groupBy("shard", "part")).applyInArrow(cut, PLACES), "shards")
    for d in done:
        left = left.unionByName(d)
    return left


def links(classes: DataFrame, scheme: Scheme, sample: int = SAMPLE) -> DataFrame:
    """Spanning links (a, b) between the classes (id, fp) that are within the radius."""
    spark = ship(classes.sparkSession)
    n = classes.count()
    seen = classes.orderBy(F.xxhash64("fp"), "fp").limit(sample).select("fp").toArrow()["fp"].to_pylist()
    x = words_of(seen)
    trees = [Tree(piece_of(x, scheme, p), scheme.piece_radius, scheme.bits // scheme.pieces, scheme.leaf * len(seen) / max(1, n), p) for p in range(scheme.pieces)] if seen else []
    shared = spark.sparkContext.broadcast(trees)

    def assign(batches):
        for b in batches:
            for p, tree in enumerate(shared.value if b.num_rows else ()):
                yield placed(tree, p, p, b.column(0), b.column(1), None, scheme)

    def meet(t: pa.Table) -> pa.Table:
        home = t["home"].to_numpy()
        order = np.argsort(~home, kind="stable")
        ids = t["id"].to_numpy()[order]
        x = words_of(t["fp"].to_pylist())[order]
        a, b = linked(x, int(home.sum()), scheme.radius, t["cross"][0].as_py())
        return pa.table([pa.array(ids[a]), pa.array(ids[b])], names=["a", "b"])

    assigned = finer(saved(classes.select("id", "fp").mapInArrow(assign, PLACES), "shards"), scheme, sample)
    return dealt(assigned.drop("piece"), "fp").groupBy("shard", "part").applyInArrow(meet, "a long, b long")


def groups(df: DataFrame, scheme: Scheme, id_col: str = "doc_id") -> DataFrame:
    """id, fp, component of every row of ``df`` (id_col, text)."""
    rows = saved(with_fingerprints(df, scheme, id_col), "fingerprints")
    classes = saved(rows.where("id is not null").groupBy("fp").agg(F.min("id").alias("id")), "classes")
    found = components(links(classes, scheme))
    classes = classes.join(found, classes["id"] == found["node"], "left").select("fp", F.coalesce("component", "id").alias("component"))
    return rows.join(classes, "fp", "left").select("id", "fp", F.when(F.col("id").isNotNull(), F.col("component")).alias("component"))


def detect(df: DataFrame, scheme: Scheme = CONTRACT) -> DataFrame:
    """doc_id, fingerprint (hex), component_id."""
    return groups(df, scheme).select(F.col("id").alias("doc_id"), F.lower(F.hex("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The hashes of a text's distinct shingles, in order."""
    return np.unique(np.frombuffer(shingle_hashes(text or "", words), dtype=">u8").astype(np.uint64))


def node_of(shingles: np.ndarray) -> int:
    """The name of a set of shingles."""
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(shingles.tobytes(), SEED) - (1 << 63)


def bands_of(h: np.ndarray, n: np.ndarray, scheme: Copies) -> np.ndarray:
    """[run, band] hashes of the bands of the runs of ``n`` hashes in ``h``; every MinHash value is the least multiple by an odd number."""
    odd = np.random.default_rng(SEED).integers(0, 1 << 63, (scheme.bands, scheme.rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    starts = np.cumsum(n) - n
    out = np.empty((len(n), scheme.bands), dtype=np.uint64)
    for b in range(scheme.bands):
        key = np.full(len(n), b, dtype=np.uint64)
        for m in odd[b]:
            key = (key ^ np.minimum.reduceat(h * m, starts)) * np.uint64(_MIX[0])
            key ^= key >> np.uint64(32)
        out[:, b] = key
    return out


def sketches(texts: list[str | None], scheme: Copies) -> tuple[list[int], list[bytes], np.ndarray]:
    """Names, fingerprints and bands of the texts' sets of shingles; a text without words has zeros."""
    sets = [shingle_set(t, scheme.words) for t in texts]
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    fps, bands = np.zeros((len(sets), scheme.bits // 8), dtype=np.uint8), np.zeros((len(sets), scheme.bands), dtype=np.uint64)
    some = np.flatnonzero(sizes)
    run = np.cumsum(sizes[some]) // 250_000
    for r in np.unique(run):
        at = some[run == r]
        h, n = np.concatenate([sets[i] for i in at]), sizes[at]
        fps[at], bands[at] = majority(h, n, scheme.bits), bands_of(h, n, scheme)
    return [node_of(x) for x in sets], [f.tobytes() for f in fps], bands.view(np.int64)


def with_sketches(df: DataFrame, scheme: Copies) -> DataFrame:
    """id, text_hash, node, fp, bands of every row of ``df`` (doc_id, text)."""
    ship(df.sparkSession)

    def run(batches):
        for b in batches:
            nodes, fps, bands = sketches(b.column(2).to_pylist(), scheme)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(nodes) + 1) * scheme.bands, pa.int32()), pa.array(bands.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(nodes, pa.int64()), pa.array(fps, pa.binary()), lists], names=["id", "text_hash", "node", "fp", "bands"])

    return df.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, "id long, text_hash long, node long, fp binary, bands array<long>")


def met(dealt_out: DataFrame, links_of) -> DataFrame:
    """Links (a, b) found by ``links_of`` (a table of one shard and part, home rows first, -> two arrays of rows) in every shard and part of two rows or more."""

    def run(batches):
        held, size = [], 0
        for b in chain(batches, [None]):
            if b is not None:
                held.append(b)
                size += b.nbytes
                if size < 8_000_000:
                    continue
            if not held:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            shard, part = t["shard"].to_numpy(), t["part"].to_numpy()
            cuts = np.flatnonzero(np.r_[True, (shard[1:] != shard[:-1]) | (part[1:] != part[:-1])]) if len(t) else np.zeros(0, int)
            ends = np.r_[cuts[1:], len(t)]
            if b is not None:  # the last part may go on in the next batch
                held = t.slice(cuts[-1]).to_batches() if len(cuts) else []
                cuts, ends, size = cuts[:-1], ends[:-1], 0
            ids = t["id"].to_numpy()
            for i, j in zip(cuts[ends - cuts > 1], ends[ends - cuts > 1]):
                x, y = links_of(t.slice(i, j - i))
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i + x]), pa.array(ids[i + y])], names=["a", "b"])

    rows = dealt_out.sortWithinPartitions("shard", "part", F.desc("home"))
    return rows.mapInArrow(run, "a long, b long")


def candidates(classes: DataFrame, scheme: Copies) -> DataFrame:
    """Spanning links (a, b) between the sets (node, fp, bands) that share a band and are within the radius."""
    ship(classes.sparkSession)

    def links_of(t: pa.Table):
        return linked(words_of(t["fp"].to_pylist()), int(t["home"].to_numpy().sum()), scheme.radius, t["cross"][0].as_py())

    assigned = classes.select(F.explode("bands").alias("shard"), F.lit(True).alias("home"), F.col("node").alias("id"), "fp")
    return met(dealt(assigned, "id", MOST_ROWS), links_of)


def treed(classes: DataFrame, scheme: Copies) -> DataFrame:
    """Spanning links (a, b) between the sets (node, fp) that vantage-point trees find: all within the trees' radius on the first bits."""
    short = classes.select("node", F.substring("fp", 1, scheme.trees.bits // 8).alias("fp"))
    equal = saved(short.groupBy("fp").agg(F.min("node").alias("id")), "tree-classes")
    own = short.join(equal, "fp").where("node <> id").select(F.col("node").alias("a"), F.col("id").alias("b"))
    return saved(own.unionByName(links(equal, scheme.trees)), "tree-links")


def alike(sets: list[np.ndarray], homes: int, similarity: float, cross: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges of the pairs of sets with a Jaccard similarity of so much or more; ``cross``: only of those between one of the first ``homes`` and one of the others."""
    n, sizes = len(sets), np.array([len(x) for x in sets])
    flat, doc = np.concatenate(sets), np.repeat(np.arange(n, dtype=np.int32), sizes)
    order = np.argsort(flat, kind="stable")
    who, new = doc[order], np.r_[True, np.diff(flat[order]) != 0][: len(flat)]
    number = np.empty(len(flat), dtype=np.int32)
    number[order] = np.cumsum(new, dtype=np.int32) - 1
    first = np.flatnonzero(new)
    count = np.diff(np.r_[first, len(flat)])
    ends = np.cumsum(sizes)
    guest = np.arange(n) >= homes
    seen, left = np.zeros(n, dtype=bool), n
    a, b = [], []
    for start in range(n):
        if seen[start] or not left:
            continue
        seen[start], left, stack = True, left - 1, [start]
        while stack and left:
            x = stack.pop()
            mine = number[ends[x] - sizes[x] : ends[x]]
            c = count[mine]
            at = np.repeat(first[mine] - np.cumsum(c) + c, c) + np.arange(c.sum())
            common = np.bincount(who[at], minlength=n)
            ok = ~seen & (common * (1 + similarity) >= similarity * (sizes + sizes[x]) - 1e-9)
            if cross:
                ok &= guest != guest[x]
            near = np.flatnonzero(ok)
            seen[near] = True
            left -= len(near)
            stack += near.tolist()
            a.append(np.full(len(near), x)), b.append(near)
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, int), np.zeros(0, int))


def verified(df: DataFrame, rows: DataFrame, found: DataFrame, scheme: Copies) -> DataFrame:
    """Spanning links (a, b) between the sets of a group (``found``: node, component) that are as similar as the scheme asks; ``rows`` (id, text_hash, node) are those of ``df``."""
    ship(df.sparkSession)

    def run(batches):
        for b in batches:
            sets = [shingle_set(t, scheme.words) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x.tobytes() for x in sets], pa.binary())], names=["shard", "id", "shingles"])

    def links_of(t: pa.Table):
        sets = [np.frombuffer(x, dtype=np.uint64) for x in t["shingles"].to_pylist()]
        return alike(sets, int(t["home"].to_numpy().sum()), scheme.similarity, t["cross"][0].as_py())

    of = rows.groupBy("node").agg(F.min(F.struct("id", "text_hash")).alias("one")).join(found, "node").select("one.id", "one.text_hash", "node", "component")
    texts = df.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("text_hash"), "text").join(of, ["id", "text_hash"]).select(F.col("component").alias("shard"), "node", "text")
    sets = saved(texts.mapInArrow(run, "shard long, id long, shingles binary").withColumn("home", F.lit(True)), "sets")
    return met(dealt(sets, "id", MOST_SETS, F.octet_length("shingles") / 8, MOST_SHINGLES), links_of)


def deduplicated(df: DataFrame, scheme: Copies = PIPELINE) -> DataFrame:
    """``df`` with one row of each group: of the smallest id (of texts with that id, the one with the smallest hash; of repeated rows, one). Rows without an id stay."""
    rows = saved(with_sketches(df, scheme).where("id is not null"), "sketches")
    classes = rows.groupBy("node").agg(F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    classes = saved(classes, "classes")
    near = components(treed(classes, scheme).unionByName(candidates(classes, scheme)))
    found = components(verified(df, rows.select("id", "text_hash", "node"), near, scheme))
    texts = rows.groupBy("id", "text_hash", "node").agg(F.count("*").alias("n"))
    named = texts.join(found, "node", "left").select("id", "text_hash", "n", F.coalesce("component", "node").alias("component"))
    first = saved(named.groupBy("component").agg(F.min(F.struct("id", "text_hash", "n")).alias("first")), "first")
    gone = named.join(first, "component").where("id <> first.id or text_hash <> first.text_hash").select("id", "text_hash")
    kept = df.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("text_hash")).join(gone, ["id", "text_hash"], "left_anti")
    repeated = first.where("first.n > 1").select("first.id", "first.text_hash")
    if not repeated.isEmpty():
        once = kept.join(repeated, ["id", "text_hash"], "left_semi").groupBy("id", "text_hash").agg(F.min_by("row", F.to_json("row")).alias("row"))
        kept = kept.join(repeated, ["id", "text_hash"], "left_anti").select("row").unionByName(once.select("row"))
    return kept.select("row.*")
