"""Mixing sources to target weights by a time-varying curriculum, in DataFrame operations only.

Every source has a schedule: its share of the mix as a function of training time from 0 to 1,
piecewise linear between knots. Integrated, it gives the source's cumulative word demand;
inverted, it gives the training position at which a word of the source's queue is due. A
document (or a repeat of it) is placed at the position of its first word, and the mix is
range-sorted by position.

A source's queue is in order of md5(doc_id). Running sums over it are taken in two levels,
over 4096 buckets by the first three hex digits and then inside a bucket, so that a source
with a third of all rows never meets in one task. Rows of one source, id and size are one entry
with a count, and its copies are numbered where they are needed, so an id (or the null id) that a
third of all rows have is no hot key either. Only ids and sizes are shuffled, no text. Sources may
be many (hosts): they are numbered over the partitions of a range sort, and the water level of the
targets is found by sums over the table of sources.

Defined results: null text has size 0 and takes no words; null source is a source of its own,
ordered last; a null id is an id like others, ahead in the queue; repeated rows count each, and
which of them takes how much is not defined where all columns in use are equal; a text of any
length is cut at the word where a source's target ends in it; an empty table gives no rows.
Columns other than doc_id, source and text are kept by ``mixed_documents`` and ignored elsewhere,
whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from stackwise.session import saved

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
#: Copies of one entry that a task numbers at a time.
COPIES = 100_000
#: Tasks that make the copies of such entries; a stated number, or adaptive execution would make it one, as a run is a few bytes before it is spread.
COPY_TASKS = 512


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def numbered(sources: DataFrame) -> DataFrame:
    """``sources`` with turn, from 0, in order of the code points of source, null last: the place in a range partition and the rows before it."""
    s = saved(sources.orderBy(F.col("source").isNull(), F.col("source")).withColumn("at", F.monotonically_increasing_id()), "sources")
    s = s.withColumn("range", F.shiftright("at", 33))
    # one row a range partition
    before = s.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return s.join(before, "range").select("source", "source_size", (F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("turn"))


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """source, source_size -> with weight and target, by filling: every target is min(most * size, level * weight).

    The level shares all words out; a source that would stop at its cap gives its excess to the
    others by weight: the level rises to (all words - the caps reached) / (weight of the rest) until
    no further cap is reached.
    """
    turn = (F.pmod(F.col("turn"), F.lit(len(weights))) + 1).cast("int")
    s = numbered(sources).select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), turn).cast("long").alias("weight"), (F.col("source_size") * most).alias("cap"))
    s = saved(s, "weights")
    total, weight = s.agg(F.sum("source_size"), F.sum("weight")).first()
    level, reached = (total / weight if weight else None), -1
    while level is not None:
        free = F.lit(level) * F.col("weight") < F.col("cap")
        n, capped, rest = s.agg(F.count_if(~free), F.coalesce(F.sum(F.when(~free, F.col("cap"))), F.lit(0)), F.sum(F.when(free, F.col("weight")))).first()
        if n == reached:
            break
        level, reached = ((total - capped) / rest if rest else None), n
    cap = F.col("cap").cast("double")
    target = cap if level is None else F.when(F.lit(level) * F.col("weight") < F.col("cap"), F.lit(level) * F.col("weight")).otherwise(cap)
    return s.select("source", "source_size", "weight", target.alias("target"))


def ramp(targets: DataFrame, strength: float = 0.5) -> DataFrame:
    """A schedule for each source: heavier sources gain share over time, lighter ones lose it, the integrals stay.

    Adds knots array<struct<t, share>>, shares summing to 1 at every knot.
    """
    total, heaviest, leaning = targets.agg(F.sum("target"), F.max("weight"), F.sum(F.col("target") * F.col("weight"))).first()
    if not total:
        total, leaning = 1.0, 0.0
    share, lean = F.col("target") / F.lit(float(total)), F.col("weight") / F.lit(float(heaviest or 1))
    lean = F.lit(strength) * (lean - F.lit(float(leaning) / total / (heaviest or 1)))
    knot = lambda at, v: F.struct(F.lit(at).cast("double").alias("t"), v.alias("share"))
    return targets.withColumn("knots", F.array(knot(0, share * (1 - lean)), knot(0.5, share), knot(1, share * (1 + lean))))


def with_demand(scheduled: DataFrame) -> DataFrame:
    """knots -> segments array<struct<t0, t1, a, b, d0, d1>>: demand in words at both ends, from integrating the shares to the target."""
    spans = F.transform(
        F.sequence(F.lit(1), F.size("knots") - 1),
        lambda i: F.struct(
            F.element_at("knots", i).t.alias("t0"), F.element_at("knots", i + 1).t.alias("t1"), F.element_at("knots", i).share.alias("a"), F.element_at("knots", i + 1).share.alias("b"),
            ((F.element_at("knots", i).share + F.element_at("knots", i + 1).share) / 2 * (F.element_at("knots", i + 1).t - F.element_at("knots", i).t)).alias("area"),
        ),
    )
    area = F.aggregate("spans", F.lit(0.0), lambda acc, x: acc + x.area)
    d = scheduled.withColumn("spans", spans).withColumn("scale", F.when(area > 0, F.col("target") / area).otherwise(F.lit(0.0)))
    before = lambda i: F.aggregate(F.slice("spans", F.lit(1), i), F.lit(0.0), lambda acc, x: acc + x.area)
    return d.withColumn("segments", F.transform("spans", lambda x, i: F.struct(x.t0.alias("t0"), x.t1.alias("t1"), x.a.alias("a"), x.b.alias("b"), (before(i) * F.col("scale")).alias("d0"), ((before(i) + x.area) * F.col("scale")).alias("d1")))).drop("spans", "knots")


def position(segments: Column, scale: Column, at: Column) -> Column:
    """Time at which the cumulative demand reaches ``at`` words: the segment's quadratic, solved in its stable form."""
    seg = F.coalesce(F.element_at(F.filter(segments, lambda s: s.d1 > at), 1), F.element_at(segments, -1))
    span = seg.t1 - seg.t0
    due = (at - seg.d0) / scale / span
    root = F.sqrt(F.greatest(F.lit(0.0), seg.a * seg.a + 2 * (seg.b - seg.a) * due))
    return seg.t0 + span * F.when(seg.a + root > 0, 2 * due / (seg.a + root)).otherwise(F.lit(0.0))


def same(a: str, b: str, keys: list[str]) -> list[Column]:
    return [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]


def sized(df: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """id, source, size, text_hash of every row, written once: texts are read no more after it."""
    return saved(df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("text_hash")), "sizes")


def queued(rows: DataFrame, weights: tuple[int, ...], most: int, schedule) -> DataFrame:
    """The entries of the queues (id, source, size, n copies, text_hash of one) with begin, the words of the queue before the first copy, and what is planned for their source."""
    light = rows.groupBy("source", "id", "size").agg(F.count("*").alias("n"), F.min("text_hash").alias("text_hash")).withColumn("h", F.md5(F.col("id").cast("string"))).withColumn("bucket", F.coalesce(F.substring("h", 1, 3), F.lit("")))
    light = saved(light, "entries")
    buckets = light.groupBy("source", "bucket").agg(F.sum(F.col("size") * F.col("n")).alias("bucket_size"))
    targets = source_targets(buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, most)
    targets = with_demand(schedule(targets))
    per_source = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("above", F.coalesce(F.sum("bucket_size").over(per_source), F.lit(0)))
    state = buckets.alias("b").join(targets.alias("t"), same("b", "t", ["source"])).select("b.source", "b.bucket", "b.above", "t.source_size", "t.target", "t.scale", "t.segments")
    placed = light.alias("d").join(state.alias("s"), same("d", "s", ["source", "bucket"])).select("d.*", "s.above", "s.source_size", "s.target", "s.scale", "s.segments")
    inside = Window.partitionBy("source", "bucket").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("begin", F.col("above") + F.coalesce(F.sum(F.col("size") * F.col("n")).over(inside), F.lit(0))).drop("above", "bucket", "h")


def copied(entries: DataFrame) -> DataFrame:
    """A row for each of the ``n`` copies of an entry, with its own begin; of very many copies every task makes a part."""
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    few = entries.where(F.col("n") <= COPIES).withColumn("k", F.explode(upto(F.col("n"))))
    many = entries.where(F.col("n") > COPIES).withColumn("run", F.explode(upto(F.ceil(F.col("n") / COPIES)))).repartition(COPY_TASKS, "id", "source", "size", "run")
    many = many.withColumn("k", F.explode(F.transform(upto(F.least(F.lit(COPIES), F.col("n") - F.col("run") * COPIES)), lambda i: F.col("run") * COPIES + i))).drop("run")
    return few.unionByName(many).withColumn("begin", F.col("begin") + F.col("k") * F.col("size")).drop("k", "n")


def taking(placed: DataFrame) -> DataFrame:
    """With taken, last (the words of the last, perhaps cut, reading) and positions (of each reading's first word).

    The queue of a source is read over and over until its target is reached; the document at the
    end is cut at the word, so a source's taken words are its target, rounded.
    """
    due = F.round("target").cast("long")
    rounds = F.when(F.col("source_size") > 0, F.floor(due / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    last = F.greatest(F.lit(0), F.least(F.col("size"), due - rounds * F.col("source_size") - F.col("begin"))).cast("long")
    placed = placed.withColumn("rounds", rounds).withColumn("last", last).withColumn("taken", F.col("rounds") * F.col("size") + F.col("last"))
    repeats = F.when(F.col("size") > 0, F.col("rounds") + (F.col("last") > 0).cast("long")).otherwise(F.lit(0)).cast("int")
    starts = F.when(repeats > 0, F.sequence(F.lit(0), repeats - 1)).otherwise(F.array().cast("array<int>"))
    return placed.withColumn("positions", F.transform(starts, lambda r: position(F.col("segments"), F.col("scale"), (F.col("begin") + r * F.col("source_size")).cast("double"))))


def mix(df: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS, schedule=ramp, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Per row of ``df``: id, source, size, source_size, target, taken, positions (of each repeat's first word), position."""
    placed = taking(copied(queued(sized(df, id_col, source_col, text_col), weights, most, schedule)))
    return placed.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "taken", "last", "positions", F.get("positions", F.lit(0)).alias("position"))


def by_position(mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows range-sorted by training position; rows that the mix leaves out come last."""
    return mixed.orderBy(F.col("position").asc_nulls_last(), id_col)


def texts_of(entries: DataFrame, rows: DataFrame) -> DataFrame:
    """Entries of several rows (n > 1) by their texts: one for each text_hash, with its own n and begin; numbered in two levels by the text's hash."""
    keys = ["source", "id", "size"]
    several = entries.where("n > 1").drop("n", "text_hash")
    texts = rows.groupBy(*keys, "text_hash").agg(F.count("*").alias("n")).withColumn("slot", F.pmod(F.col("text_hash"), F.lit(4096)))
    slots = texts.groupBy(*keys, "slot").agg(F.sum("n").alias("of_slot"))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.withColumn("above", F.coalesce(F.sum("of_slot").over(earlier(Window.partitionBy(*keys).orderBy("slot"))), F.lit(0)))
    t = texts.alias("t").join(slots.alias("s"), same("t", "s", [*keys, "slot"])).select("t.*", "s.above")
    t = t.withColumn("first", F.col("above") + F.coalesce(F.sum("n").over(earlier(Window.partitionBy(*keys, "slot").orderBy("text_hash"))), F.lit(0)))
    out = several.alias("e").join(t.alias("t"), same("e", "t", keys)).select("e.*", "t.n", "t.text_hash", "t.first")
    return out.withColumn("begin", F.col("begin") + F.col("first") * F.col("size")).drop("first")


def mixed_documents(df: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS, schedule=ramp) -> DataFrame:
    """The documents as the mix takes them: a row per repeat, range-sorted by position, the last one cut at its last word due.

    Documents of no word are dropped, as the mix takes none of their words. Rows that repeat an id
    are each taken by their own place in the queue; of rows that repeat id, source and text, all
    are taken as the one whose columns come first.
    """
    keys = ["id", "source", "text_hash"]
    rows = sized(df, "doc_id", "source", "text")
    entries = queued(rows, weights, most, schedule)
    plan = entries.where("n = 1")
    repeated = None
    if not entries.where("n > 1").isEmpty():
        texts = saved(texts_of(entries, rows), "texts")
        plan = plan.unionByName(texts)
        repeated = texts.where("n > 1").select(*keys)
    plan = taking(copied(plan)).where("taken > 0")
    plan = plan.select(*keys, "last", "size", F.size("positions").alias("of"), F.posexplode("positions").alias("turn", "at"))
    docs = df.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.col("source").alias("source"), F.xxhash64("text").alias("text_hash"))
    if repeated is not None and not repeated.isEmpty():
        again = same("d", "r", keys)
        once = docs.alias("d").join(repeated.alias("r"), again, "left_semi").groupBy(*keys).agg(F.min_by("row", F.to_json("row")).alias("row"))
        docs = docs.alias("d").join(repeated.alias("r"), again, "left_anti").unionByName(once.select("row", *keys))
    rows = docs.alias("d").join(plan.alias("p"), same("d", "p", keys)).select("d.row", "p.last", "p.size", "p.of", "p.turn", "p.at", "p.id").orderBy("at", "id", "turn")
    part = (F.col("turn") == F.col("of") - 1) & (F.col("last") > 0) & (F.col("last") < F.col("size"))
    cut = F.array_join(F.slice(F.regexp_extract_all("row.text", F.lit(f"({WORD}[\\x20\\x09-\\x0D]*)"), F.lit(1)), F.lit(1), F.col("last").cast("int")), "")
    row = F.col("row").withField("text", F.when(part, cut).otherwise(F.col("row.text")))
    if "n_chars" in df.columns:
        row = row.withField("n_chars", F.when(part, F.length(cut)).otherwise(F.col("row.n_chars")).cast(df.schema["n_chars"].dataType))
    return rows.select(row.alias("row")).select("row.*")
