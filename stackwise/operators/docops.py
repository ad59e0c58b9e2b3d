"""Reading documents: grep, pages of chunks, reconstruction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

LINE_CHARS = 2000


def numbered_lines(docs: DataFrame, text_col: str = "raw_text") -> DataFrame:
    """doc_id, line (from 1), offset (of its first character), line_text; a running sum inside the row, no shuffle."""
    lines = F.split(text_col, "\n")
    with_offset = F.aggregate(
        F.col("_lines"),
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<offset:bigint,line_text:string>>").alias("out")),
        lambda acc, x: F.struct((acc["at"] + F.length(x) + 1).cast("long").alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("offset"), x.alias("line_text")))).alias("out")),
        lambda acc: acc["out"],
    )
    # quadratic in the lines of a document through the growing array: a window does it in order for long ones
    short = docs.select("doc_id", lines.alias("_lines")).where(F.size("_lines") <= 64)
    long = docs.select("doc_id", lines.alias("_lines")).where(F.size("_lines") > 64)
    a = short.select("doc_id", F.posexplode(with_offset).alias("p", "x")).select("doc_id", (F.col("p") + 1).alias("line"), "x.offset", "x.line_text")
    w = Window.partitionBy("doc_id").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    b = long.select("doc_id", F.posexplode("_lines").alias("p", "line_text")).select("doc_id", (F.col("p") + 1).alias("line"), F.coalesce(F.sum(F.length("line_text") + 1).over(w), F.lit(0)).cast("long").alias("offset"), "line_text")
    return a.unionByName(b)


def grep(docs: DataFrame, pattern: str, most: int = 50, ignore_case: bool = True, text_col: str = "raw_text") -> DataFrame:
    """doc_id, n (of the match in its document), line, char_start, char_end, match, total_matches; the first ``most`` of each document.

    Lines are cut to 2000 characters. A match's place is found by cutting the line at its matches, in order.
    """
    most = max(1, min(200, most))
    flagged = ("(?i)" if ignore_case else "") + pattern
    lines = numbered_lines(docs, text_col).withColumn("cut", F.substring("line_text", 1, LINE_CHARS))
    hit = lines.where(F.regexp_like("cut", F.lit(flagged)))
    between = F.split("cut", flagged)
    found = F.regexp_extract_all("cut", F.lit(f"({flagged})" if not ignore_case else f"(?i)({pattern})"), F.lit(1))
    hit = hit.withColumn("_between", between).withColumn("_found", found)
    start = lambda i: F.aggregate(F.slice("_between", F.lit(1), i + 1), F.lit(0), lambda a, x: a + F.length(x)) + F.aggregate(F.slice("_found", F.lit(1), i), F.lit(0), lambda a, x: a + F.length(x))
    m = hit.select("doc_id", "line", "offset", F.posexplode(F.transform("_found", lambda x, i: F.struct(x.alias("match"), start(i).alias("at")))).alias("i", "m"))
    m = m.where(F.length("m.match") > 0)
    w = Window.partitionBy("doc_id")
    n = F.row_number().over(w.orderBy("line", "i"))
    m = m.withColumn("n", n).withColumn("total_matches", F.count("*").over(w)).where(F.col("n") <= most)
    return m.select("doc_id", "n", "line", (F.col("offset") + F.col("m.at")).cast("long").alias("char_start"), (F.col("offset") + F.col("m.at") + F.length("m.match")).cast("long").alias("char_end"), F.col("m.match").alias("match"), "total_matches")


def reconstructed(chunks: DataFrame) -> DataFrame:
    """doc_id, text: the chunks of a document in order, a blank line between."""
    rows = F.array_sort(F.collect_list(F.struct("idx", "text")))
    return chunks.groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda r: r.text), "\n\n").alias("text"))


def chunk_page(chunks: DataFrame, doc_id, offset: int, limit: int) -> DataFrame:
    """A page of one document's chunks in order."""
    return chunks.where(F.col("doc_id") == F.lit(doc_id)).orderBy("idx").offset(offset).limit(limit)
