"""Quality classifier: supervised subword embeddings.

Words, pairs of neighbouring words and character 3- and 4-grams are hashed to rows of an
embedding table; a document is the average of its rows, followed by a softmax layer. Both are
learned by stochastic gradient descent in numpy, on the driver, from a bounded sample of
labelled documents (``per_class`` of each class, in order of a hash of the id, one text of each
id, of at most ``MOST_CHARS`` characters). Since the average and the layer are linear, a trained
model is folded to one number a row, so that scoring a text is a sum over its features: each
task scores whole texts, no shuffle. A very long text is summed up piece by piece (pairs and
n-grams do not cross from one piece of two million characters to the next).

Defined results: null and empty texts, and texts of white space, score the trained layer's
bias (no features); with labels of one class only, or none, every score is the share of
label 1 (0.5 without labels); of contradicting labels of one id the larger counts, and of
texts of one id the one with the smallest hash is learned from. Repeated rows score alike; an
empty table gives no rows; other columns are ignored, whatever they are called.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from stackwise.llm.common import batches_of_text, pieces_of, release_unused
from stackwise.llm.ngrams import Grams
from stackwise.session import ship

BUCKETS_LOG2 = 18
#: The bound of the training sample: documents of each class.
PER_CLASS = 1500
#: The bound of a text in that sample; longer ones are scored, and not learned from.
MOST_CHARS = 200_000
MODEL = {"dim": 8, "epochs": 4, "rate": 0.5, "row_rate": 30.0, "seed": 7}


def features(texts: list[str], buckets_log2: int = BUCKETS_LOG2) -> tuple[np.ndarray, np.ndarray]:
    """Rows of all features, and the text of each."""
    g = Grams(texts)
    shift = np.uint32(32 - buckets_log2)
    rows, docs = [], []
    w = g.words()
    p, at = g.pairs(w)
    for h, word in ((w, np.arange(len(w))), (p, at), g.gram(3), g.gram(4)):
        rows.append(h >> shift)
        docs.append(g.word_doc[word])
    return np.concatenate(rows), np.concatenate(docs)


class Model:
    def __init__(self, table: np.ndarray, bias: float):
        self.table, self.bias = table, bias

    def scores(self, texts: list[str]) -> np.ndarray:
        out = np.empty(len(texts))
        for first, part in batches_of_text(texts):
            n, z = np.zeros(len(part)), np.zeros(len(part))
            for some in [part] if len(part) > 1 else ([x] for x in pieces_of(part[0])):
                rows, docs = features(some)
                n += np.bincount(docs, minlength=len(part))
                z += np.bincount(docs, weights=self.table[rows], minlength=len(part))
            z = z / np.maximum(n, 1) + self.bias
            out[first : first + len(part)] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return out


def train(texts: list[str], labels: list[int], dim: int, epochs: int, rate: float, row_rate: float, seed: int) -> Model:
    y = np.array(labels, dtype=int)
    share = y.mean() if len(y) else 0.5
    if not 0 < share < 1:
        p = min(max(share, 1e-9), 1 - 1e-9)
        return Model(np.zeros(1 << BUCKETS_LOG2, dtype=np.float32), float(np.log(p / (1 - p))))
    bags = []
    for t in texts:
        rows, _ = features([t])
        u, n = np.unique(rows, return_counts=True)
        bags.append((u, (n / max(1, n.sum())).astype(np.float32)))
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1 / dim, 1 / dim, (1 << BUCKETS_LOG2, dim)).astype(np.float32)
    out = np.zeros((dim, 2), dtype=np.float32)
    bias = np.zeros(2, dtype=np.float32)
    for epoch in range(epochs):
        step = 1 - epoch / epochs
        for i in rng.permutation(len(y)):
            u, x = bags[i]
            rows = emb[u]
            h = x @ rows
            z = h @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            dh = out @ p
            out -= rate * step * np.outer(h, p)
            bias -= 0.05 * rate * step * p
            emb[u] = rows - (row_rate * step) * np.outer(x, dh)
    return Model((emb @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def in_fold(doc_id: Column, of: int, fold: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(of)) == fold


def fit(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, label_col: str = "quality") -> Model:
    """``labels`` are the rows to learn from: doc_id and ``label_col``."""
    labels = labels.where(F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label_col).cast("int").alias("y"))
    labels = labels.withColumn("h", F.xxhash64("doc_id"))
    picked = labels.where("y = 0").orderBy("h", "doc_id").limit(per_class).unionByName(labels.where("y = 1").orderBy("h", "doc_id").limit(per_class))
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.length("text") <= MOST_CHARS).join(F.broadcast(picked), "doc_id")
    # partial aggregation first: an id that many rows repeat is one row of a task
    rows = texts.groupBy("doc_id", "h", "y").agg(F.min(F.struct(F.xxhash64("text"), "text"))["text"].alias("text")).toArrow()
    rows = rows.sort_by([("h", "ascending"), ("doc_id", "ascending"), ("text", "ascending")])
    model = train(rows["text"].to_pylist(), rows["y"].to_pylist(), **MODEL)
    del rows
    release_unused()
    return model


def score(df: DataFrame, model: Model, extra: list[str] | None = None) -> DataFrame:
    """The columns ``extra`` of ``df`` (by default all) with a score; a column of that name is replaced."""
    ship(df.sparkSession)
    keep = [c for c in (df.columns if extra is None else extra) if c != "score"]
    shared = df.sparkSession.sparkContext.broadcast((model.table, model.bias))

    def run(batches):
        m = Model(*shared.value)
        for b in batches:
            s = m.scores([t or "" for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], names=["row", "score"])

    rows = df.select(F.struct(*keep).alias("row"), F.col("text"))
    return rows.mapInArrow(run, T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())])).select("row.*", "score")


def classify(documents: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, **options) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, learned from the labels outside the fold ``held``."""
    model = fit(documents, labels.where(~in_fold(F.col("doc_id"), folds, held)), **options)
    out = score(documents, model, ["doc_id"])
    return out.select("doc_id", in_fold(F.col("doc_id"), folds, held).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
