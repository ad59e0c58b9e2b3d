"""Ingest as set operations: de-duplication, conflicts, reuse of vectors, writes, synchronisation."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, FloatType, StructType

from stackwise.functions import text as T
from stackwise.operators.catalog import numbered_in
from stackwise.operators.store import ChunkStore
from stackwise.session import saved, ship


def deduplicated(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """incoming (base_id, doc_id, raw_text) with content_hash, duplicate_of: a stored document of the same text and base, or the batch's first."""
    i = incoming.withColumn("content_hash", T.content_hash(F.col("raw_text")))
    s = stored.groupBy("base_id", "content_hash").agg(F.min("doc_id").alias("_stored"))
    # an aggregate and a join, and no window: a text that a third of a batch has is not one task's
    first = i.groupBy("base_id", "content_hash").agg(F.min("doc_id").alias("_first")).join(s, ["base_id", "content_hash"], "left")
    a, b = i.alias("a"), first.alias("b")
    on = F.col("a.base_id").eqNullSafe(F.col("b.base_id")) & F.col("a.content_hash").eqNullSafe(F.col("b.content_hash"))
    out = a.join(b, on, "left").select("a.*", "b._stored", "b._first")
    return out.withColumn("duplicate_of", F.coalesce("_stored", F.when(F.col("_first") != F.col("doc_id"), F.col("_first")))).drop("_stored", "_first")


def name_conflicts(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """incoming (base_id, file_name, seq) with conflict: the name is stored in the base, or comes earlier in the batch."""
    s = stored.where("file_name is not null").select("base_id", "file_name").distinct().withColumn("_taken", F.lit(True))
    # aggregates and a join, and no window: a name that a third of a batch has is not one task's
    first = incoming.groupBy("base_id", "file_name").agg(F.min("seq").alias("_first")).join(s, ["base_id", "file_name"], "left")
    a, b = incoming.alias("a"), first.alias("b")
    on = F.col("a.base_id").eqNullSafe(F.col("b.base_id")) & F.col("a.file_name").eqNullSafe(F.col("b.file_name"))
    return a.join(b, on).select("a.*", (F.col("b._taken").isNotNull() | (F.col("a.seq") > F.col("b._first"))).alias("conflict"))


def _split_name() -> tuple[Column, Column]:
    stem = F.when(F.col("file_name").rlike(r"^.+\.[^.]*$"), F.regexp_extract("file_name", r"^(.+)\.[^.]*$", 1)).otherwise(F.col("file_name"))
    return stem, F.regexp_extract("file_name", r"^.+(\.[^.]*)$", 1)


def resolved(incoming: DataFrame, stored: DataFrame, policy: str) -> DataFrame:
    """incoming with action (add, skip, replace, rename, conflict) and new_name.

    rename takes the first free name_N.ext: the batch's rows of one name take the free numbers in order of seq.
    The used number u, i-th of its name, has u - i free numbers below it; so in the order of these values, with the k-th
    row of the batch at k and ahead of a used number of the same value, a row's place is its number. All places
    are those of range sorts, so a name may have any number of rows.
    """
    c = name_conflicts(incoming, stored)
    action = F.when(~F.col("conflict"), "add").otherwise({"keep": "skip", "replace": "replace", "rename": "rename", "detect": "conflict"}[policy])
    c = c.withColumn("action", action).drop("conflict")
    if policy != "rename":
        return c.withColumn("new_name", F.col("file_name"))
    group = ["base_id", "_stem", "_ext"]
    stem, ext = _split_name()
    c = saved(c, "conflicts")
    rows = c.where("action = 'rename'").select("base_id", stem.alias("_stem"), ext.alias("_ext"), "seq", F.struct(*[F.col(x) for x in c.columns]).alias("_row"))
    rows = numbered_in(rows, group, ["seq"], "_value").withColumn("_used", F.lit(0))
    used = stored.select("base_id", "file_name").unionByName(incoming.select("base_id", "file_name"))
    number = F.regexp_extract("file_name", r"_([1-9][0-9]{0,17})(\.[^.]*)?$", 1)
    used = used.select("base_id", F.regexp_extract("file_name", r"^(.*)_[1-9][0-9]*(\.[^.]*)?$", 1).alias("_stem"), F.regexp_extract("file_name", r"_[1-9][0-9]*(\.[^.]*)$", 1).alias("_ext"), F.when(number != "", number).alias("_n"))
    used = used.where("_n is not null").withColumn("_n", F.col("_n").cast("long")).distinct()
    used = numbered_in(used, group, ["_n"], "_i").select(*group, (F.col("_n") - F.col("_i")).alias("_value"), F.lit(1).alias("_used"))
    both = numbered_in(rows.select(*group, "_value", "_used", "_row").unionByName(used, allowMissingColumns=True), group, ["_value", "_used"], "_number")
    name = F.concat("_stem", F.lit("_"), F.col("_number").cast("string"), "_ext")
    renamed = both.where("_used = 0").select("_row.*", name.alias("new_name"))
    return c.where("action <> 'rename'").withColumn("new_name", F.col("file_name")).unionByName(renamed)


def batch_conflicts(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Distinct names of a batch that collide, with what is stored or inside the batch."""
    return name_conflicts(incoming, stored).where("conflict").select("base_id", "file_name").distinct()


def reused_vectors(chunks: DataFrame, stored: DataFrame) -> DataFrame:
    """chunks (embedding_text_hash, embedding_model) with the vector stored under the same hash and model, or null.

    The stored side has one vector for each key first, or rows would multiply.
    """
    s = stored.where("embedding is not null").groupBy("embedding_text_hash", "embedding_model").agg(F.min_by("embedding", "chunk_id").alias("embedding"))
    return chunks.drop("embedding").join(s, ["embedding_text_hash", "embedding_model"], "left")


def hashing_embedder(width: int = 64):
    """A deterministic stand-in for an embedding service: hashed words, unit length."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> list[float]:
            v = np.zeros(width)
            for w in (t or "").lower().split():
                h = hashlib.blake2b(w.encode(), digest_size=8).digest()
                v[int.from_bytes(h[:4], "little") % width] += 1 if h[4] & 1 else -1
            n = np.linalg.norm(v)
            return (v / n if n else v).tolist()

        return texts.map(one)

    return embed


class EmbeddingError(RuntimeError):
    """An embedding service gave another number of vectors than it was given texts."""


def pooled(vectors: np.ndarray, pooling: str) -> np.ndarray:
    """The vector of a text from those of its tokens [token, width]: their mean, the first (cls) or the last."""
    return vectors.mean(0) if pooling == "mean" else vectors[0] if pooling == "cls" else vectors[-1]


def embed_batches(rows: DataFrame, text_col: str, service: Callable[[], Callable[[list[str]], list]], batch: int = 32, attempts: int = 3, base: float = 1.0, most: float = 30.0, pooling: str | None = None, out: str = "embedding") -> DataFrame:
    """``rows`` with vectors by a service, ``batch`` texts a call, gathered over Arrow batches.

    ``service()`` is made once a task and takes a list of texts to as many vectors (or, with ``pooling``, to arrays of token
    vectors). A call that raises is made again after base * 2^n seconds; one that gives another number of vectors
    raises EmbeddingError, and is not tried again. Null texts get no vector and are not sent.
    """
    ship(rows.sparkSession)
    schema = StructType([f for f in rows.schema if f.name != out]).add(out, ArrayType(FloatType()))
    names, at = [f.name for f in schema], [c for c in rows.columns if c != out].index(text_col)

    def run(batches):
        call = service()

        def vectors(texts: list[str]) -> list:
            found = with_retry(lambda: call(texts), attempts, base, most)
            if len(found) != len(texts):
                raise EmbeddingError(f"{len(found)} vectors for {len(texts)} texts")
            return [pooled(np.asarray(v, float), pooling) if pooling else v for v in found]

        held: list[pa.RecordBatch] = []
        waiting = 0

        def finish(upto: int):
            table = pa.Table.from_batches(held).combine_chunks()
            texts, result = table.column(at).slice(0, upto).to_pylist(), [None] * upto
            some = [i for i, t in enumerate(texts) if t is not None]
            for k in range(0, len(some), batch):
                part = some[k : k + batch]
                for i, v in zip(part, vectors([texts[i] for i in part])):
                    result[i] = [float(x) for x in v]
            done = table.slice(0, upto).append_column(out, pa.array(result, pa.list_(pa.float32())))
            return done.select(names).to_batches(), table.slice(upto).to_batches()

        for b in batches:
            held.append(b)
            waiting += b.num_rows
            if waiting >= batch:
                ready, held = finish(waiting - waiting % batch)
                waiting %= batch
                yield from ready
        if waiting:
            yield from finish(waiting)[0]

    return rows.select(*[c for c in rows.columns if c != out]).mapInArrow(run, schema)


def embedded(chunks: DataFrame, stored: DataFrame, embed, model_tag: str) -> DataFrame:
    """Chunks with vectors: reused where there is one, else by ``embed``, a function of a column or of a table of rows with search_text; only rows without a vector pass it."""
    r = reused_vectors(chunks.withColumn("embedding_model", F.lit(model_tag)), stored)
    have, need = r.where("embedding is not null"), r.where("embedding is null")
    done = embed(need) if getattr(embed, "takes_rows", False) else need.withColumn("embedding", embed(F.col("search_text")))
    return have.unionByName(done)


def by_service(service, **options):
    """An ``embed`` for ``embedded`` and ``ingested`` that calls a service in batches."""

    def embed(rows: DataFrame) -> DataFrame:
        return embed_batches(rows, "search_text", service, **options)

    embed.takes_rows = True
    return embed


def put_chunks(store: ChunkStore, new: DataFrame, stream: tuple[str, int] | None = None) -> int | None:
    """Replace, in one commit: all stored chunks of the new chunks' documents go."""
    return store.put(new, ["base_id", "doc_id"], stream)


def put_batch(store: ChunkStore, new: DataFrame, stream: tuple[str, int] | None = None) -> int | None:
    """Upsert by chunk id, in one commit; of repeated new ids the last by idx stays."""
    # an aggregate: an id that a third of a batch has is not one task's
    last = new.groupBy("chunk_id").agg(F.max_by(F.struct(*[c for c in new.columns if c != "chunk_id"]), "idx").alias("_row")).select("chunk_id", "_row.*")
    return store.put(last.select(*new.columns), ["chunk_id"], stream)


def delete_chunks(store: ChunkStore, gone: DataFrame) -> int | None:
    """Chunks whose keys (all columns of ``gone``: doc_id, base_id or both) are in ``gone``."""
    return store.delete(gone)


def legacy_chunks(rows: DataFrame) -> DataFrame:
    """Imported rows (chunk_id, doc_id, idx, seq): the last of each id stays, ordered by idx."""
    last = F.row_number().over(Window.partitionBy("chunk_id").orderBy(F.col("seq").desc()))
    return rows.withColumn("_r", last).where("_r = 1").drop("_r").orderBy("doc_id", "idx", "chunk_id")


def disk_sync(disk: DataFrame, stored: DataFrame) -> DataFrame:
    """path, action: only on disk is add, only stored is delete, both is reindex."""
    d, s = disk.select("path").distinct().withColumn("_d", F.lit(1)), stored.select("path").distinct().withColumn("_s", F.lit(1))
    action = F.when(F.col("_s").isNull(), "add").when(F.col("_d").isNull(), "delete").otherwise("reindex")
    return d.join(s, "path", "full").select("path", action.alias("action"))


def rescanned(disk: DataFrame, stored: DataFrame) -> DataFrame:
    """path, action, error of ``disk`` (path, error) against ``stored`` (path): as ``disk_sync`` says; an entry that could not be read has failed, and the others go on."""
    errors = disk.groupBy("path").agg(F.min("error").alias("error"))
    synced = disk_sync(disk, stored).join(errors, "path", "left")
    return synced.withColumn("action", F.when(F.col("error").isNotNull(), "failed").otherwise(F.col("action")))


def refresh_due(docs: DataFrame, hours: int, now_ms: int) -> DataFrame:
    """URL documents last touched over so many hours ago."""
    return docs.where((F.col("source_type") == "url") & (F.coalesce("updated_at", "created_at") < now_ms - hours * 3_600_000)) if hours > 0 else docs.where(F.lit(False))


def refreshed(docs: DataFrame, fetched: DataFrame) -> DataFrame:
    """fetched (doc_id, title, raw_text) against docs: changed is false where text and title are the same."""
    f = fetched.select("doc_id", F.col("title").alias("_title"), F.col("raw_text").alias("_text"))
    same = F.col("_title").eqNullSafe(F.col("title")) & (T.content_hash(F.col("_text")).eqNullSafe(T.content_hash(F.col("raw_text"))))
    return docs.join(f, "doc_id").select("doc_id", F.col("_title").alias("title"), F.col("_text").alias("raw_text"), (~same).alias("changed"))


def reindex_source(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """doc_id, source_text, origin: the stored text, or else the chunks put together again."""
    from stackwise.operators.docops import reconstructed

    r = reconstructed(chunks).withColumnRenamed("text", "_again")
    origin = F.when(F.length("raw_text") > 0, "text").when(F.length("_again") > 0, "chunks")
    return docs.where("source_type <> 'directory'").join(r, "doc_id", "left").select("doc_id", F.when(F.length("raw_text") > 0, F.col("raw_text")).otherwise(F.col("_again")).alias("source_text"), origin.alias("origin"))


def restored(docs: DataFrame, base_id, new_base) -> DataFrame:
    """Copies of a base's documents in a new base; directories are left out and the tree is flat."""
    d = docs.where((F.col("base_id") == F.lit(base_id)) & (F.col("source_type") != "directory"))
    return d.withColumn("base_id", F.lit(new_base)).withColumn("doc_id", F.sha2(F.concat_ws(":", F.lit(str(new_base)), F.col("doc_id").cast("string")), 256)).withColumn("parent_directory_id", F.lit(None).cast("string"))


def model_route(documents: int, busy: bool, sourceless: int, old: str | None, new: str | None) -> str:
    """What changing a base's model does: save, backfill or refuse."""
    if documents == 0 or old == new:
        return "save"
    if old is None and new is not None:
        return "refuse" if busy or sourceless else "backfill"
    return "refuse"


def with_retry(call, attempts: int = 3, base: float = 1.0, most: float = 30.0, sleep=None):
    """``call()`` tried again after base * 2^n seconds, at most ``most``."""
    import time

    for n in range(attempts):
        try:
            return call()
        except Exception:
            if n == attempts - 1:
                raise
            (sleep or time.sleep)(min(most, base * 2**n))


def ingested(incoming: DataFrame, stored_docs: DataFrame, stored_chunks: DataFrame, embed=None, model_tag: str | None = None, **chunking) -> tuple[DataFrame, DataFrame]:
    """(documents with counts, chunks) of the incoming documents that are no duplicates."""
    from stackwise.operators.chunking import finished, with_chunks

    fresh = deduplicated(incoming, stored_docs).where("duplicate_of is null").drop("duplicate_of")
    chunks = finished(with_chunks(fresh.select("base_id", "doc_id", "title", "raw_text"), **chunking), model_tag)
    if embed is not None and model_tag is not None:
        chunks = embedded(chunks, stored_chunks, embed, model_tag)
    counts = chunks.groupBy("doc_id").agg(F.count("*").alias("chunk_count"))
    docs = fresh.withColumn("char_count", F.length("raw_text").cast("long")).withColumn("token_count", T.est_tokens(F.col("raw_text"))).join(counts, "doc_id", "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))
    return docs, chunks
