"""Retrieval quality over batches of questions."""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from stackwise.session import saved, ship


def judged(hits: DataFrame, expected: DataFrame) -> DataFrame:
    """hits (question_id, rank, title) against expected (question_id, expect array): a row per question with found, wanted, first_rank."""
    e = expected.select("question_id", F.posexplode_outer("expect").alias("pos", "part"))
    match = F.contains(F.col("title"), F.col("part"))
    j = e.join(hits, "question_id", "left").groupBy("question_id", "pos", "part").agg(F.min(F.when(match, F.col("rank"))).alias("first"))
    return j.groupBy("question_id").agg(F.count("first").alias("found"), F.count("part").alias("wanted"), F.min("first").alias("first_rank"))


def scores(j: DataFrame, by: list[str] | None = None) -> DataFrame:
    """hit_at_k (mean), recall_at_k (found of all wanted, pooled), mrr (over all questions)."""
    aggs = [F.avg((F.col("found") > 0).cast("double")).alias("hit_at_k"), (F.sum("found") / F.sum("wanted")).alias("recall_at_k"), F.avg(F.coalesce(F.lit(1.0) / F.col("first_rank"), F.lit(0.0))).alias("mrr"), F.count("*").alias("questions")]
    return j.groupBy(*by).agg(*aggs) if by else j.agg(*aggs)


def folded(c: Column) -> Column:
    """Without white space, punctuation and symbols, lower-cased."""
    return F.lower(F.regexp_replace(c, r"[\s\p{P}\p{S}]", ""))


def context_recall(golden: DataFrame, hits: DataFrame, least: int = 4) -> DataFrame:
    """question_id, recall: the share of the golden answer's sentences that the hits' texts, in order, contain; questions without an answer are left out."""
    sentences = F.filter(F.transform(F.split("golden", "[。！？!?\n]"), lambda x: F.trim(x)), lambda x: x != "")
    s = golden.where("golden is not null").select("question_id", F.explode(sentences).alias("sentence")).select("question_id", folded(F.col("sentence")).alias("s"))
    rows = F.array_sort(F.collect_list(F.struct("rank", F.concat_ws(" ", "text", "sibling_context").alias("t"))))
    texts = hits.groupBy("question_id").agg(folded(F.array_join(F.transform(rows, lambda r: r.t), " ")).alias("all"))
    j = s.join(texts, "question_id", "left").select("question_id", ((F.length("s") >= least) & F.coalesce(F.contains("all", "s"), F.lit(False))).alias("ok"))
    return j.groupBy("question_id").agg(F.avg(F.col("ok").cast("double")).alias("recall"))


#: Passages, and bytes of them, that are looked for in one pass over the documents.
BATCH, BATCH_BYTES = 20_000, 64 << 20


class Holders:
    """Which of the known passages a text contains whole.

    White space on both sides of an inner word of a passage is there in the text too, so two inner words that follow each other
    do so in the text. A passage is looked for in the texts that have such a pair of its words (the longest), or the only inner
    word; the few passages without one are looked for in every text.
    """

    def __init__(self, passages: list[str]):
        self.passages, self.pairs, self.words, self.short = passages, {}, {}, []
        for i, p in enumerate(passages):
            inner = p.split()[1:-1]
            if len(inner) > 1:
                self.pairs.setdefault(max(zip(inner, inner[1:]), key=lambda x: len(x[0]) + len(x[1])), []).append(i)
            elif inner:
                self.words.setdefault(inner[0], []).append(i)
            else:
                self.short.append(i)
        self.first = frozenset(a for a, _ in self.pairs)

    def __call__(self, text: str) -> list[int]:
        words = text.split()
        near = [i for w in self.words.keys() & set(words) for i in self.words[w]] if self.words else []
        if self.first.intersection(words):
            near += [i for x in self.pairs.keys() & set(zip(words, words[1:])) for i in self.pairs[x]]
        return [i for i in chain(self.short, near) if self.passages[i] in text]


def holders(documents: DataFrame, passages: DataFrame) -> DataFrame:
    """doc_id, item_id: documents (doc_id, text) that contain a passage (item_id, passage) whole.

    The passages go in batches to the tasks that read the texts, so no text and no word of it is shuffled.
    """
    spark = ship(documents.sparkSession)
    passages = saved(passages.where("passage is not null").select("item_id", "passage"), "passages")
    n, size = passages.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("passage")), F.lit(0))).first()
    passes = max(1, -(-n // BATCH), -(-size // BATCH_BYTES))
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((documents, "doc_id"), (passages, "item_id"))]

    def searched(batch: DataFrame) -> DataFrame:
        t = batch.toArrow().combine_chunks()
        shared = spark.sparkContext.broadcast((t["item_id"].combine_chunks(), t["passage"].to_pylist()) if len(t) else None)

        def run(batches):
            if shared.value is None:
                return
            items, texts = shared.value
            held = Holders(texts)
            for b in batches:
                found = [held(x) if x is not None else [] for x in b.column(1).to_pylist()]
                row = np.repeat(np.arange(len(found)), list(map(len, found)))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), items.take(pa.array(chain.from_iterable(found), pa.int64()))], names=["doc_id", "item_id"])

        return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kinds[0]}, item_id {kinds[1]}")

    out = None
    for i in range(passes):
        own = searched(passages if passes == 1 else passages.where(F.pmod(F.xxhash64("item_id", "passage"), F.lit(passes)) == i))
        out = own if out is None else out.unionByName(own)
    return out
