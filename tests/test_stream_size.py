"""What a stream of upserts shuffles and keeps of its texts."""

from pyspark.sql import functions as F

from stackwise.streaming import ingest as stream


def test_texts_of_single_documents_are_not_shuffled(spark):
    rows = [("b", str(i), "t", f"text {i}", 1) for i in range(9)] + [(None, "n", "t", "alone", 1)]
    frame = lambda rows: spark.createDataFrame(rows, "base_id string, doc_id string, title string, raw_text string, day int").withColumn("created_at", F.make_timestamp(F.lit(2024), F.lit(1), "day", F.lit(0), F.lit(0), F.lit(0))).drop("day")
    once = stream.latest(frame(rows))
    assert "Exchange" not in once._jdf.queryExecution().executedPlan().toString() and once.count() == 10
    more = rows + [("b", "3", "t2", "later", 2), (None, "n", "t", "twice", 1), ("b", "4", "t", None, 3), ("b", "5", "t", "zz", 1)]
    got = {(r.base_id, r.doc_id): (r.title, r.raw_text) for r in stream.latest(frame(more)).collect()}
    assert len(got) == 10 and got["b", "3"] == ("t2", "later") and got[None, "n"] == ("t", "twice") and got["b", "4"] == ("t", None) and got["b", "5"] == ("t", "zz") and got["b", "6"] == ("t", "text 6")


def test_segments_are_packed(spark, tmp_path):
    s = stream.ChunkStore(spark, str(tmp_path / "s"))
    s.put(spark.range(50).select(F.col("id").alias("chunk_id"), F.col("id").alias("doc_id"), F.lit("b").alias("base_id"), F.lit("rain on the river").alias("text")))
    files = [p.name for p in (tmp_path / "s").rglob("*.parquet") if p.is_file()]
    assert files and all(".zstd." in f for f in files)


def test_a_table_of_one_file_or_a_folder_is_streamed(spark, sf, tmp_path):
    from stackwise import queries

    spark.read.parquet(f"{sf}/documents.parquet").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    rows = lambda d: sorted(map(str, queries.QUERIES["stream_upsert"](spark, d).collect()))
    assert rows(sf) == rows(str(tmp_path))
