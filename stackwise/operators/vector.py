"""Exact vector lane over batches of queries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from stackwise.functions import vectors as V
from stackwise.operators.lexical import Best, top
from stackwise.session import saved, ship


#: Queries that are scored in one pass over the corpus; of more, there is a pass for every so many.
BATCH = 20_000
#: Scores that a task holds at once, and rows of a batch of pairs.
SLAB, MOST_ROWS = 4_000_000, 100_000
DIGITS = 6


def pairs(corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, chunk_id, query_embedding, embedding of all pairs of one width, for results that are the product by definition.

    The corpus is dealt to as many blocks as there are shuffle partitions, and each block gets the queries, so
    that no key, not even the only width there is, meets in one task.
    """
    n = int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    c = corpus.select("chunk_id", "embedding", F.size("embedding").alias("width"), F.pmod(F.xxhash64("chunk_id"), F.lit(n)).cast("int").alias("block"))
    q = queries.select("query_id", F.col("embedding").alias("query_embedding"), F.size("embedding").alias("width"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block")).where("width > 0")
    return c.join(q.hint("shuffle_hash"), ["block", "width"]).select("query_id", "chunk_id", "query_embedding", "embedding")


def cosine_topk(corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, chunk_id, score, rank by the clamped cosine. Vectors of another width, and null ones, have no score."""
    return batch_topk(corpus, queries, k)


def units_by_width(ids: pa.Array, vectors: pa.Array, unit: bool = True) -> dict[int, tuple[pa.Array, np.ndarray]]:
    """Ids, in order, and the vectors at length one (or as they are), of each width; null and empty vectors are left out."""
    width = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    out = {}
    for w in np.unique(width[width > 0]):
        at = np.flatnonzero(width == w)
        own = ids.take(pa.array(at))
        at = at[np.array(pc.sort_indices(own))]
        x = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(at), -1)
        out[int(w)] = ids.take(pa.array(at)), x / np.maximum(np.sqrt((x * x).sum(1)), 1e-300)[:, None] if unit else x
    return out


def _blocks(corpus: DataFrame, queries: DataFrame, task, schema: str, block: int, unit: bool = True) -> DataFrame:
    """What ``task(scores, query_ids)`` makes of the corpus in each task, in passes of ``BATCH`` queries, which go to all tasks.

    ``scores`` are (width, first query, rounded scores of a slab of queries by a block of rows, the rows' ids in order); neither
    pairs nor a task's scores are held whole.
    """
    spark = ship(corpus.sparkSession)
    asked = queries.where("embedding is not null").select("query_id", "embedding")
    passes = max(1, -(-asked.count() // BATCH))

    def lane(batch: DataFrame) -> DataFrame:
        rows = batch.toArrow().combine_chunks()
        shared = spark.sparkContext.broadcast(units_by_width(rows["query_id"].combine_chunks(), rows["embedding"].combine_chunks(), unit) if len(rows) else {})

        def run(batches):
            def scores():
                for b in batches:
                    for w, (ids, x) in units_by_width(b.column(0), b.column(1), unit).items():
                        if w not in shared.value:
                            continue
                        q = shared.value[w][1]
                        for i in range(0, len(ids), block):
                            own = x[i : i + block].T
                            slab = max(1, SLAB // own.shape[1])
                            for j in range(0, len(q), slab):
                                yield w, j, np.round(np.nan_to_num(np.clip(q[j : j + slab] @ own, 0, 1)), DIGITS), ids.slice(i, block)

            yield from task(scores(), {w: ids for w, (ids, _) in shared.value.items()})

        return corpus.select("chunk_id", "embedding").mapInArrow(run, schema)

    out = None
    for i in range(passes):
        part = lane(asked if passes == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == i))
        out = part if out is None else out.unionByName(part)
    return out


def _kinds(corpus: DataFrame, queries: DataFrame) -> tuple[str, str]:
    return queries.schema["query_id"].dataType.simpleString(), corpus.schema["chunk_id"].dataType.simpleString()


def batch_topk(corpus: DataFrame, queries: DataFrame, k: int, block: int = 4096) -> DataFrame:
    """The same by matrix products: each task keeps k a query of all its rows; a window merges the tasks' results.

    Scores are rounded once, as in the final ranking, and ties go to the smaller id there and here, so
    the result does not depend on batches.
    """

    def task(scores, query_ids):
        best = {w: Best(len(ids), k) for w, ids in query_ids.items()}
        for w, first, s, ids in scores:
            best[w].add(first, s, ids)
        for w, kept in best.items():
            if (found := kept.trim()) is not None:
                q, s, ids = found
                yield pa.RecordBatch.from_arrays([query_ids[w].take(pa.array(q)), ids, pa.array(s)], names=["query_id", "chunk_id", "score"])

    a, b = _kinds(corpus, queries)
    return top(_blocks(corpus, queries, task, f"query_id {a}, chunk_id {b}, score double", block), k, digits=DIGITS)


def matched(corpus: DataFrame, queries: DataFrame, block: int = 4096) -> DataFrame:
    """query_id, scored: how many rows have a cosine above 0 by rounded score; queries without any are left out.

    Every query is compared with every vector of its width, and tasks' counts are all that is shuffled.
    """

    def task(scores, query_ids):
        n = {w: np.zeros(len(ids), np.int64) for w, ids in query_ids.items()}
        for w, first, s, _ in scores:
            n[w][first : first + len(s)] += (s > 0).sum(1)
        for w, count in n.items():
            at = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([query_ids[w].take(pa.array(at)), pa.array(count[at])], names=["query_id", "n"])

    counts = _blocks(corpus, queries, task, f"query_id {_kinds(corpus, queries)[0]}, n long", block)
    return counts.groupBy("query_id").agg(F.sum("n").alias("scored"))


def dots(corpus: DataFrame, queries: DataFrame, block: int = 4096) -> DataFrame:
    """query_id, chunk_id, score: the product of every query and every row of its width, clamped and rounded; all pairs, none shuffled."""

    def task(scores, query_ids):
        for w, first, s, ids in scores:
            for i in range(0, len(s), rows := max(1, MOST_ROWS // s.shape[1])):
                part = s[i : i + rows]
                q = query_ids[w].take(pa.array(np.repeat(np.arange(first + i, first + i + len(part)), s.shape[1])))
                yield pa.RecordBatch.from_arrays([q, ids.take(pa.array(np.tile(np.arange(len(ids)), len(part)))), pa.array(part.ravel())], names=["query_id", "chunk_id", "score"])

    a, b = _kinds(corpus, queries)
    return _blocks(corpus, queries, task, f"query_id {a}, chunk_id {b}, score double", block, unit=False)


#: Queries whose wanted pairs go to the tasks in one pass of ``places``.
PLACED = 5_000


def places(corpus: DataFrame, queries: DataFrame, wanted: DataFrame, block: int = 4096) -> DataFrame:
    """``wanted`` (query_id, chunk_id), a bounded number a query, with score and place: from 1, in the whole lane by rounded score and then id.

    Pairs without a score (null vectors, other widths) are left out. Tasks count, for each wanted pair, their rows that
    come before it, and only these counts are shuffled: neither pairs nor ranks of the whole lane are made.
    """
    spark = ship(corpus.sparkSession)
    scale = 10**DIGITS  # rounded as numpy does in the tasks, half to even
    unit = lambda df, name: df.where(F.size("embedding") > 0).withColumn(name, V.normalized(F.col("embedding")))
    w = wanted.select("query_id", "chunk_id").join(unit(corpus, "_c").select("chunk_id", "_c"), "chunk_id").join(unit(queries, "_q").select("query_id", "_q"), "query_id")
    w = saved(w.where(F.size("_c") == F.size("_q")).select("query_id", "chunk_id", F.round(V.unit_dot(F.col("_q"), F.col("_c")), DIGITS).alias("score")), "wanted")
    asked = queries.join(w.select("query_id").distinct(), "query_id", "left_semi").where("embedding is not null").select("query_id", "embedding")
    passes = max(1, -(-asked.count() // PLACED))
    kinds = {f.name: f.dataType.simpleString() for f in w.schema}

    def counted(part: DataFrame, pairs: DataFrame) -> DataFrame:
        rows, want = part.toArrow().combine_chunks(), pairs.orderBy("query_id", "chunk_id").toArrow().combine_chunks()
        mine: dict = {}
        for i, q in enumerate(want["query_id"].to_pylist()):
            mine.setdefault(q, []).append(i)
        units = units_by_width(rows["query_id"].combine_chunks(), rows["embedding"].combine_chunks()) if len(rows) else {}
        chunks = want["chunk_id"].to_numpy()
        below = scale - np.rint(want["score"].to_numpy() * scale).astype(np.int64)
        shared = spark.sparkContext.broadcast((units, {q: np.array(at) for q, at in mine.items()}, want.select(["query_id", "chunk_id"]), chunks, below))

        def run(batches):
            units, mine, want, chunks, below = shared.value
            n = np.zeros(len(chunks), np.int64)
            for b in batches:
                for width, (ids, x) in units_by_width(b.column(0), b.column(1)).items():
                    if width not in units:
                        continue
                    query_ids, q = units[width]
                    for i in range(0, len(ids), block):
                        own = ids.slice(i, block)
                        s = np.round(np.nan_to_num(np.clip(q @ x[i : i + block].T, 0, 1)), DIGITS)
                        # one number for score and id: rows are in order of id
                        rank = (scale - np.rint(s * scale).astype(np.int64)) * (block + 1) + np.arange(len(own))
                        rank.sort(axis=1)
                        at_id = np.searchsorted(own.to_numpy(zero_copy_only=False), chunks)
                        for p, query in enumerate(query_ids.to_pylist()):
                            at = mine[query]
                            n[at] += np.searchsorted(rank[p], below[at] * (block + 1) + at_id[at])
            some = np.flatnonzero(n)
            if len(some):
                out = want.take(pa.array(some)).append_column("n", pa.array(n[some]))
                yield from out.combine_chunks().to_batches()

        return corpus.select("chunk_id", "embedding").mapInArrow(run, f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, n long")

    out = None
    for i in range(passes):
        of = lambda df: df if passes == 1 else df.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == i)  # noqa: B023, E731
        part = counted(of(asked), of(w))
        out = part if out is None else out.unionByName(part)
    before = out.groupBy("query_id", "chunk_id").agg(F.sum("n").alias("n"))
    return w.join(before, ["query_id", "chunk_id"], "left").select("query_id", "chunk_id", "score", (F.coalesce("n", F.lit(0)) + 1).alias("place"))


def dimensions(corpus: DataFrame) -> DataFrame:
    """By model: vectors, widths and whether there is one width only."""
    return corpus.where("embedding is not null").groupBy("embedding_model").agg(F.count("*").alias("vectors"), F.count_distinct(F.size("embedding")).alias("widths"), F.min(F.size("embedding")).alias("width")).withColumn("consistent", F.col("widths") == 1)


def only(chunks: DataFrame, hits: DataFrame, key: str) -> DataFrame:
    """``chunks`` of the hits' ``key`` alone. The hits, which are few, go to where chunks are read, before their texts are shuffled for what else joins to them."""
    return chunks.join(hits.select(key), key, "left_semi")


def with_neighbours(hits: DataFrame, chunks: DataFrame, radius: int) -> DataFrame:
    """hits (doc_id, idx) with sibling_context: the texts of the chunks up to ``radius`` away in the document, in order, with their headings.

    Each hit asks for its places, by an equi-join on (doc_id, idx): other chunks of its document, however many, are not sorted.
    """
    if radius <= 0:
        return hits.withColumn("sibling_context", F.lit(None).cast("string"))
    shown = F.concat(F.when(F.length("heading") > 0, F.concat(F.lit("["), F.col("heading"), F.lit("] "))).otherwise(F.lit("")), F.col("text"))
    near = hits.select("doc_id", "idx").distinct().withColumn("near", F.explode(F.sequence(F.col("idx") - radius, F.col("idx") + radius))).where("near <> idx")
    own = near.join(only(chunks, hits, "doc_id").select("doc_id", F.col("idx").alias("near"), shown.alias("shown")), ["doc_id", "near"])
    rows = F.array_sort(F.collect_list(F.struct("near", "shown")))
    own = own.groupBy("doc_id", "idx").agg(F.array_join(F.transform(rows, lambda x: x.shown), "\n\n").alias("sibling_context"))
    return hits.join(own, ["doc_id", "idx"], "left").withColumn("sibling_context", F.coalesce("sibling_context", F.lit("")))
