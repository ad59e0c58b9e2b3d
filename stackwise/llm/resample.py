"""Target-distribution importance resampling over hashed features.

Documents become a sparse matrix, a row a document and a column a bucket of hashed features (runs of 1
to ``longest`` consecutive words), written once as CSR blocks: a row of the table is a block of many
documents with row pointers, column numbers and counts. Column sums of the blocks (one vector of
``BUCKETS`` numbers a task, summed by Spark) give the distribution of the corpus, those of the target's blocks
that of the target. The logarithm of their smoothed ratio is a bucket's gain, and a block times the vector
of gains gives its documents' weights. With Gumbel noise from the document's id the highest scores
are a sample without replacement, in proportion to exp(weight / 1000).

A block holds about ``BLOCK_FEATURES`` features, a longer document is a block alone; texts are split in
pieces, so a task holds one text and one block. What goes to the driver and back are vectors of
``BUCKETS`` numbers, whatever the tables' sizes. The draw is numbered over a range sort of ids and
scores, by the rows before each partition; rows that tie in both are spread by their number.

Defined results: null and empty texts have no feature, weight 0, and are never drawn where ``least_words``
is over 0; a null id has the noise of an empty id and comes before others at equal scores; repeated rows are scored alike
and drawn one by one; a text of any length is taken whole; an empty table gives no rows, an empty target the gains of
no features. Columns other than the id and the text are ignored, whatever they are called.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from stackwise.llm.common import WordCache
from stackwise.session import saved, ship

BUCKETS = 10_000
BLOCK_FEATURES = 200_000
#: Bytes of a text that are split into words at a time.
PIECE_BYTES = 4_000_000
SEED = 2024
SCALE = 1000
#: A-Z to a-z, and every byte that is in no word to a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
BLOCK = "doc_ids array<long>, words array<long>, features array<long>, pointers array<long>, columns array<int>, counts array<long>"


def words_of(text: str | None) -> Iterator[list[bytes]]:
    """The words of a whole text, in lists of bounded length."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(FOLD)
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + PIECE_BYTES)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


def features_of(text: str | None, bucket, longest: int) -> tuple[int, int, dict[int, int]]:
    """Words, features, and the count of each bucket that has one."""
    n_words = n_features = 0
    total: dict[int, int] = {}
    last: deque[bytes] = deque(maxlen=max(1, longest - 1))
    for words in words_of(text):
        n_words += len(words)
        found = list(map(bucket, words))
        for n in range(2, longest + 1):
            run = [*last, *words]
            first = max(0, len(last) - n + 1)
            found += [bucket(b" ".join(run[i : i + n])) for i in range(first, len(run) - n + 1)]
        last.extend(words[-(longest - 1) :] if longest > 1 else [])
        n_features += len(found)
        at, count = np.unique(np.array(found, np.int32), return_counts=True)
        for b, c in zip(at.tolist(), count.tolist()):
            total[b] = total.get(b, 0) + c
    return n_words, n_features, total


def blocks(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """The documents of ``df`` as CSR blocks."""
    ship(df.sparkSession)
    schema = pa.schema([(n, pa.list_(pa.int32() if n == "columns" else pa.int64())) for n in ("doc_ids", "words", "features", "pointers", "columns", "counts")])

    def run(batches):
        cache = WordCache(lambda w: zlib.crc32(w) % buckets, 300_000)
        bucket = cache.__getitem__
        block, size = ([], [], [], [0], [], []), 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(block, schema.types)], schema=schema)

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                n_words, n_features, counts = features_of(text.as_py(), bucket, longest)
                order = sorted(counts)
                for column, value in zip(block, (doc_id, n_words, n_features)):
                    column.append(value)
                block[4].extend(order)
                block[5].extend(map(counts.__getitem__, order))
                block[3].append(len(block[4]))
                size += n_features + 1
                if size >= BLOCK_FEATURES:
                    yield out()
                    block, size = ([], [], [], [0], [], []), 0
        if block[0]:
            yield out()

    return df.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, BLOCK)


def column_sums(matrix: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket: every task sums its blocks up, Spark sums the tasks' vectors."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            np.add.at(total, b.column(0).flatten().to_numpy(), b.column(1).flatten().to_numpy())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    rows = matrix.select("columns", "counts").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the smoothed ratio of target to corpus) of each bucket, in doubles."""
    s, t = corpus.astype(float), target.astype(float)
    n = float(len(corpus))
    return np.floor(SCALE * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def weights(matrix: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight: every block times the vector of gains."""
    shared = ship(matrix.sparkSession).sparkContext.broadcast(gain)

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                doc_ids, words, features, pointers, columns, counts = (b.column(k)[i].values for k in range(6))
                products = np.concatenate([[0], np.cumsum(shared.value[columns.to_numpy()] * counts.to_numpy())])
                p = pointers.to_numpy()
                yield pa.RecordBatch.from_arrays([doc_ids, words, features, pa.array(products[p[1:]] - products[p[:-1]], pa.int64())], names=["doc_id", "n_words", "n_features", "weight"])

    return matrix.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noisy(weighted: DataFrame, seed: int = SEED) -> DataFrame:
    """With score: the weight and Gumbel noise from a hash of the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-SCALE) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    return weighted.withColumn("score", F.col("weight") + noise.cast("long"))


def drawn(scored: DataFrame, percent: int, least_words: int) -> DataFrame:
    """With rank, from 1, of the floor(percent * N / 100) highest scores of the N documents with so many words; null for others."""
    key = [F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("row")]
    scored = saved(scored.withColumn("row", F.monotonically_increasing_id()), "scores")
    able = saved(scored.where(F.col("n_words") >= least_words).orderBy(*key).withColumn("at", F.monotonically_increasing_id()), "order").withColumn("range", F.shiftright("at", 33))
    # one row a range partition
    sizes = able.groupBy("range").agg(F.count("*").alias("n"))
    before = sizes.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy()).alias("of"))
    place = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    able = able.join(F.broadcast(before), "range").withColumn("rank", F.when(place <= F.floor(F.col("of") * percent / 100), place))
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    columns = ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    return able.select(*columns).unionByName(rest.select(*columns))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, longest: int = 1, buckets: int = BUCKETS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_features, weight, score, rank in the draw or null."""
    matrix = saved(blocks(docs, id_col, text_col, longest, buckets), "matrix")
    wanted = blocks(target.select(F.lit(None).cast("long").alias("id"), F.col(target_text_col).alias("text")), "id", "text", longest, buckets)
    gain = gains(column_sums(matrix, buckets), column_sums(wanted, buckets))
    return drawn(noisy(weights(matrix, gain), seed), percent, least_words).withColumnRenamed("doc_id", id_col)
