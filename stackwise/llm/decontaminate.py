"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations only.

An item's windows are its runs of ``window`` words (a shorter item is one window). A window is a set of
shingles of ``shingle`` words, each at its place. It can only be in a document that holds all of its
shingles, so the necessary prefix at full containment is one shingle, the rarest.

1. The items give the table of their shingles (a hash, and the words, so that hashes that collide do no harm).
2. Documents are read once. Of all places in a document those stay whose shingle is an item's: postings
   (row, place, shingle), with the words around the place that a window there could cover, and the place's
   distance to both ends of the text. Every document adds a row of its own, with its number of words.
3. Shingles are put in order of rarity by their number of postings; windows with a shingle that no
   document has are dropped, the others join the postings by their rarest.
4. Candidates must lie inside the text (the bounds of place and length), and are compared word by word.
5. The windows of a document that remain are merged from left to right to count the words inside.

The shingles are broadcast in parts of at most ``MOST_BROADCAST`` keys of 8 bytes; a larger benchmark takes
a pass over the documents for each part, over a written copy with row numbers. Nothing else is broadcast
but by Spark's own sizes. Only postings are shuffled, no text: a passage that a third of all documents
share makes postings in each of them, counted by partial aggregates; the join by a hot shingle has few
windows on its other side, so that skewed joins can split it.

Defined results: null and empty texts, and texts without a word, have no words; so have items, which are in
no document; items with equal ids are one item, a null id is an item written as an empty string; each
row of the documents has a row in the result, repeated and null ids too; a text of any length is taken whole;
an empty table gives no rows, an empty benchmark documents without a hit. Columns other than the ids
and texts are ignored, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stackwise.functions.text import ascii_lower
from stackwise.session import saved

#: Letters and digits after A-Z are lower-cased; everything outside ASCII is part of a word.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
SHINGLE = 5
#: Keys of shingles that are broadcast at a time (some 30 MB in a hash table).
MOST_BROADCAST = 1_000_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def windows_of(items: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """item_id (as a string), words: the distinct windows of each item."""
    i = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item_id"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (window - 1)))
    return i.select("item_id", F.explode(F.transform(starts, lambda s: F.slice("w", s, F.lit(window)))).alias("words")).distinct()


def key_at(w: Column, place: Column, length: int) -> Column:
    """Hash of the ``length`` words from ``place`` (from 0)."""
    return F.xxhash64(F.lit(length), *[F.get(w, place + i) for i in range(length)])


def shingles_of(windows: DataFrame, shingle: int) -> DataFrame:
    """wid, length (words of the window), offset, n (words of the shingle), key, shingle."""
    n = F.least(F.lit(shingle), F.size("words"))
    s = windows.select("wid", "words", n.alias("n"), F.explode(F.sequence(F.lit(0), F.size("words") - n)).alias("offset"))
    key = F.lit(None).cast("long")
    for length in range(1, shingle + 1):
        key = F.when(F.col("n") == length, key_at(F.col("words"), F.col("offset"), length)).otherwise(key)
    return s.select("wid", F.size("words").alias("length"), "offset", "n", key.alias("key"), F.slice("words", F.col("offset") + 1, F.col("n")).alias("shingle"))


def postings(docs: DataFrame, keys: DataFrame, lengths: list[int], window: int, headers: bool) -> DataFrame:
    """row, doc_id, n_words, place, key, left (of the words kept, how many come before the place), around: places whose shingle has one of ``keys``.

    With ``headers`` a row of place -1 for every document; others have no doc_id.
    """
    places = F.sequence(F.lit(-1) if headers else F.lit(0), F.size("w") - 1)
    d = docs.withColumn("place", F.explode(F.when(F.size("w") > 0, places).otherwise(F.array(F.lit(-1)) if headers else F.array().cast("array<int>"))))
    key = lambda n: F.when((F.col("place") >= 0) & (F.col("place") + n <= F.size("w")), key_at(F.col("w"), F.col("place"), n))
    if len(lengths) == 1:
        d = d.withColumn("key", key(lengths[0]))
    else:
        d = d.withColumn("key", F.explode(F.when(F.col("place") >= 0, F.array(*map(key, lengths))).otherwise(F.array(F.lit(None).cast("long")))))
    found = d.join(F.broadcast(keys.withColumn("known", F.lit(True))), "key", "left" if headers else "inner")
    if headers:
        found = found.where("known or place < 0")
    left = F.least(F.col("place"), F.lit(window - 1))
    around = F.when(F.col("place") >= 0, F.slice("w", F.greatest(F.lit(1), F.col("place") - left + 1), left + window))
    return found.select("row", F.when(F.col("place") < 0, F.col("doc_id")).alias("doc_id"), F.size("w").alias("n_words"), "place", "key", left.alias("left"), around.alias("around"))


def covered(spans: Column) -> Column:
    """Words inside the union of spans array<struct<first, last>> (last not included), in order of first."""
    zero = F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n"))

    def step(acc, s):
        more = F.greatest(F.lit(0), s["last"] - F.greatest(s["first"], acc["upto"]))
        return F.struct(F.greatest(acc["upto"], s["last"]).alias("upto"), (acc["n"] + more).alias("n"))

    return F.aggregate(spans, zero, step)["n"]


def contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: its id, n_words, n_hit, spans (merged from the left, as found), items (their ids as strings, sorted)."""
    own = windows_of(items, window, item_col, item_text_col)
    # equal windows of several items are searched once
    own = saved(own.withColumn("wid", F.xxhash64(F.concat_ws(" ", "words"))), "windows")
    distinct = own.select("wid", "words").distinct()
    grams = saved(shingles_of(distinct, shingle), "shingles")
    lengths = [r.n for r in grams.select("n").distinct().orderBy("n").collect()] or [shingle]
    keys = saved(grams.select("key").distinct(), "keys")
    parts = max(1, -(-keys.count() // MOST_BROADCAST))

    d = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if parts > 1:
        d = saved(d, "rows")
    d = d.select("row", "doc_id", words(F.col("text")).alias("w"))
    found = None
    for i in range(parts):
        p = postings(d, keys if parts == 1 else keys.where(F.pmod(F.xxhash64("key"), F.lit(parts)) == i), lengths, window, i == 0)
        found = p if found is None else found.unionByName(p)
    found = saved(found, "postings")
    rows, found = found.where("place < 0").select("row", "doc_id", "n_words"), found.where("place >= 0")

    rarity = found.groupBy("key").agg(F.count("*").alias("rarity"))
    per_window = grams.join(rarity, "key", "left").groupBy("wid", "length")
    # windows with a shingle that is nowhere have no occurrence; of the others the rarest shingle is the prefix
    rarest = per_window.agg(F.bool_and(F.col("rarity").isNotNull()).alias("whole"), F.min(F.struct("rarity", "key", "offset")).alias("first")).where("whole")
    prefix = rarest.select("wid", "length", F.col("first.key").alias("key"), F.col("first.offset").alias("offset"))
    prefix = saved(prefix.join(distinct, "wid").select("wid", "length", "key", "offset", "words"), "prefix")
    start = F.col("place") - F.col("offset")
    # bounds first: the window begins in the text and ends in it
    fits = (start >= 0) & (start + F.col("length") <= F.col("n_words"))
    equal = F.slice("around", F.col("left") - F.col("offset") + 1, F.col("length")) == F.col("words")
    hits = found.join(prefix, "key").where(fits).where(equal).select("row", "wid", start.alias("first"), (start + F.col("length")).alias("last"))
    hits = saved(hits, "hits")
    spans = hits.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("first", "last"))).alias("spans"))
    named = hits.select("row", "wid").distinct().join(own.select("wid", "item_id"), "wid").groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    per_row = spans.join(named, "row")
    out = rows.join(per_row, "row", "left")
    none = F.array().cast("array<string>")
    return out.select(F.col("doc_id").alias(id_col), F.col("n_words").cast("long").alias("n_words"), F.coalesce(covered(F.col("spans")), F.lit(0).cast("long")).alias("n_hit"), "spans", F.coalesce("items", none).alias("items"))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return found.select(id_col, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def clean(found: DataFrame, most_share: float = 0.0) -> DataFrame:
    """The documents of which at most such a share of words is hit."""
    return found.where(F.col("n_hit") <= F.lit(most_share) * F.col("n_words"))
