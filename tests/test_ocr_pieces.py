"""OCR's spaces: between ideographs only, and what stands between recognised pieces stays."""

from oracle import connected
from pyspark.sql import functions as F

from stackwise import queries
from stackwise.functions import text as T

TEXTS = ["", " ", "知识", "库", "あ い", "한국 어", "a 知", "知 ", "\n字", None, "plain text"]


def test_only_ideographs_are_drawn_together(spark):
    rows = spark.createDataFrame([("中 文\t测　试 字\n字",), ("か な カ ナ",), ("한 국 어",), ("漢 字 か な",)], "text string")
    assert [r[0] for r in rows.select(T.ocr_despaced(F.col("text"))).collect()] == ["中文测试字\n字", "か な カ ナ", "한 국 어", "漢字 か な"]


def test_texts_that_meet_the_pieces_equal_the_sql(spark, sf, tmp_path):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = dict(map(tuple, queries.QUERIES["ocr_postprocess"](spark, str(tmp_path)).collect()))
    c = connected(sf)
    c.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == dict(c.execute(queries.ORACLES["ocr_postprocess"]).fetchall())
