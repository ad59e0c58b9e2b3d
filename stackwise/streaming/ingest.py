"""Incremental ingest as a stream: files of documents in, chunks out; equal to the batch result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from stackwise.functions import text as T
from stackwise.operators.chunking import finished, with_chunks
from stackwise.operators.store import ChunkStore
from stackwise.session import discard, saved

DOCUMENTS = StructType().add("base_id", "string").add("doc_id", "string").add("title", "string").add("raw_text", "string").add("created_at", "timestamp")


def source(spark: SparkSession, folder: str, schema: StructType = DOCUMENTS, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def chunk_stream(docs: DataFrame, delay: str = "30 days", **chunking) -> DataFrame:
    """Chunks of a stream of documents (base_id, doc_id, title, raw_text, created_at).

    Of equal texts in a base the first to arrive stays, as far back as the watermark reaches
    (state is dropped beyond it, so it does not grow with the history).
    """
    d = docs.withColumn("content_hash", T.content_hash(F.col("raw_text"))).withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["base_id", "content_hash"])
    return finished(with_chunks(d.select("base_id", "doc_id", "title", "raw_text"), **chunking))


def start(chunks: DataFrame, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Appends to Parquet, exactly once by the checkpoint."""
    w = chunks.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")).start()


def windowed_counts(events: DataFrame, time_col: str = "ts", delay: str = "10 minutes", width: str = "1 hour", by: str = "event_type") -> DataFrame:
    """Rows by event-time window and ``by``; late rows beyond the watermark are left out."""
    return events.withWatermark(time_col, delay).groupBy(F.window(time_col, width), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), by, "n")


DOCUMENT = ["base_id", "doc_id"]


def latest(batch: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """One row a document: the last by created_at (of equal times, the greatest text).

    ``known`` (base_id, doc_id, n) has how often ``batch`` holds each document. Only the texts of those that it holds more than once are shuffled.
    """
    columns = [*DOCUMENT, "title", "raw_text"]
    known = batch.groupBy(*DOCUMENT).agg(F.count("*").alias("n")) if known is None else known
    again = known.where("n > 1").select(*[F.col(c).alias(f"_{c}") for c in DOCUMENT])
    if again.isEmpty():
        return batch.select(*columns)
    same = F.equal_null(F.col("base_id"), F.col("_base_id")) & F.equal_null(F.col("doc_id"), F.col("_doc_id"))
    last = batch.join(again, same, "left_semi").groupBy(*DOCUMENT).agg(F.max(F.struct("created_at", "raw_text", "title")).alias("_r"))
    return batch.join(again, same, "left_anti").select(*columns).unionByName(last.select(*DOCUMENT, F.col("_r.title").alias("title"), F.col("_r.raw_text").alias("raw_text")))


def upserts(docs: DataFrame, store: ChunkStore, name: str, checkpoint: str, available_now: bool = True, before_commit: Callable[[int], None] | None = None, **chunking) -> StreamingQuery:
    """A stream of documents (base_id, doc_id, title, raw_text, created_at) into a store: of each batch one commit, which replaces the documents' chunks.

    The commit holds the batch's number under ``name``: a batch that is run again, as after a stop between
    its commit and the stream's own record of it, changes nothing. A null or empty text removes the document's chunks.
    A batch's files are read twice, for its keys and for its texts, and no copy of the texts is kept beside the store.
    """

    def run(batch: DataFrame, number: int) -> None:
        known = saved(batch.groupBy(*DOCUMENT).agg(F.count("*").alias("n")), "known")
        chunks = finished(with_chunks(latest(batch, known).where(F.length("raw_text") > 0), **chunking))
        if before_commit:
            before_commit(number)
        store.put(chunks, stream=(name, number), deletes=known.select(*DOCUMENT))
        discard(known)

    w = docs.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")).start()
