"""Rerankers in a plan: a model that scores pairs in batches, and a service that takes a query with its candidates.

Both take ranked (query_id, chunk_id, query, text, rank), a bounded pool of candidates for each query, and answer with
(query_id, chunk_id, new, error): scores in [0, 1] of the candidates that stay, or an error of a query. Queries of one
candidate are not asked. ``applied`` puts the answers into effect: a query that failed, or got no score, keeps its
order and scores, and the others go on. Null queries and texts are sent as empty ones.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from stackwise.operators import fusion
from stackwise.operators.ingest import with_retry
from stackwise.session import saved, ship


class RerankError(RuntimeError):
    """A reranker's refusal, with the status that it gave: some are the same at every attempt."""

    def __init__(self, message: str, status: int | None = None):
        super().__init__(message)
        self.status = status


# The statuses of a wrong key or address.
LASTING = (401, 403, 404)


def clamped(x) -> float:
    """A score in [0, 1]; what is no number is 0."""
    return 0.0 if x is None or math.isnan(x) else max(0.0, min(1.0, float(x)))


def sigmoid(x) -> float | None:
    if x is None:
        return None
    return 1 / (1 + math.exp(-x)) if x >= 0 else 1 - 1 / (1 + math.exp(x))


def attempt(call: Callable, attempts: int, base: float, most: float):
    """(result, None) or (None, error): tried again unless the error is a lasting one."""

    def once():
        try:
            return call(), None
        except Exception as e:
            if getattr(e, "status", None) in LASTING:
                return None, e
            raise

    try:
        return with_retry(once, attempts, base, most)
    except Exception as e:  # a query that fails must not stop the others
        return None, e


def _schema(ranked: DataFrame) -> str:
    kind = lambda c: ranked.schema[c].dataType.simpleString()
    return f"query_id {kind('query_id')}, chunk_id {kind('chunk_id')}, new double, error string"


def _batch(query_ids: list, chunk_ids: list, new: list, errors: list, kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = [pa.array(query_ids, kinds[0]), pa.array(chunk_ids, kinds[1]), pa.array(new, pa.float64()), pa.array(errors, pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=["query_id", "chunk_id", "new", "error"])


def _several(ranked: DataFrame) -> DataFrame:
    """Candidates of the queries that have more than one."""
    of = Window.partitionBy("query_id")
    sent = [F.coalesce(c, F.lit("")).alias(c) for c in ("query", "text")]
    return ranked.withColumn("_n", F.count("*").over(of)).where("_n > 1").select("query_id", "chunk_id", *sent, "rank")


def by_model(ranked: DataFrame, model: Callable[[], Callable[[list[tuple[str, str]]], list]], top_n: int | None = None, batch: int = 16, attempts: int = 1, base: float = 1.0, most: float = 30.0) -> DataFrame:
    """Answers of a cross-encoder: ``model()`` is loaded once a task and takes (query, text) pairs to as many logits.

    Pairs are dealt evenly to all tasks and scored ``batch`` at a time, whatever queries they are of. A batch that fails
    is scored again query by query, so that only the query at fault fails. A pair without a logit has 0. Of each query
    the ``top_n`` best stay (at least one), of equal scores those that were ranked before.
    """
    spark = ship(ranked.sparkSession)
    pairs = _several(ranked).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "query_id", "chunk_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        load: list = []

        def scores(rows: list[tuple]) -> tuple[list, list]:
            found, error = attempt(lambda: load[0]([(r[2], r[3]) for r in rows]), attempts, base, most)
            if error is None:
                logits = list(found)[: len(rows)]
                return [clamped(sigmoid(x)) for x in logits + [None] * (len(rows) - len(logits))], [None] * len(rows)
            return [None] * len(rows), [str(error)] * len(rows)

        def answers(rows: list[tuple], kinds) -> pa.RecordBatch:
            new, errors = scores(rows)
            queries = {r[0] for r in rows}
            if errors[0] is not None and len(queries) > 1:
                for q in queries:
                    at = [i for i, r in enumerate(rows) if r[0] == q]
                    for i, x, e in zip(at, *scores([rows[i] for i in at])):
                        new[i], errors[i] = x, e
            return _batch([r[0] for r in rows], [r[1] for r in rows], new, errors, kinds)

        held: list[tuple] = []
        kinds: list = []
        for b in batches:
            if not load:
                load.append(model())
            kinds = [b.schema.field(0).type, b.schema.field(1).type]
            held += zip(*(b.column(i).to_pylist() for i in range(4)))
            while len(held) >= batch:
                yield answers(held[:batch], kinds)
                held = held[batch:]
        if held:
            yield answers(held, kinds)

    found = pairs.select("query_id", "chunk_id", "query", "text").mapInArrow(run, _schema(ranked))
    if top_n is None:
        return found
    # the ranks decide among equal scores; errors stay
    found = saved(found, "scores").join(ranked.select("query_id", "chunk_id", "rank"), ["query_id", "chunk_id"])
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("new").desc_nulls_last(), "rank"))
    return found.withColumn("_place", place).where(F.col("error").isNotNull() | (F.col("_place") <= max(1, int(top_n)))).drop("_place", "rank")


def by_service(ranked: DataFrame, service: Callable[[], Callable[[str, list[str], int], list[tuple]]], top_n: int | None = None, attempts: int = 1, base: float = 1.0, most: float = 30.0) -> DataFrame:
    """Answers of a service: ``service()`` is made once a task and takes (query, texts, top_n) to (index, score) of those that it keeps.

    One call a query. An index that there is not, and the second of an index, is left out; a score that is no number is
    0. ``top_n`` is asked for, at least 1 and at most all; a service that returns more is taken at its word.
    """
    ship(ranked.sparkSession)
    pool = F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "text")))
    pools = _several(ranked).groupBy("query_id").agg(F.first("query").alias("query"), pool.alias("pool"))
    pools = pools.select("query_id", "query", F.col("pool.chunk_id").alias("chunk_ids"), F.col("pool.text").alias("texts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = None
        for b in batches:
            call = call or service()
            out: list[list] = [[], [], [], []]
            for q, query, chunk_ids, texts in zip(*(b.column(i).to_pylist() for i in range(4))):
                keep = len(texts) if top_n is None else max(1, min(int(top_n), len(texts)))
                found, error = attempt(lambda: call(query, texts, keep), attempts, base, most)  # noqa: B023
                kept: dict = {}
                for i, x in found or []:
                    if isinstance(i, int) and 0 <= i < len(texts):
                        kept.setdefault(i, clamped(x if isinstance(x, (int, float)) else None))
                rows = [(q, chunk_ids[i], x, None) for i, x in kept.items()] if error is None else [(q, chunk_ids[0], None, str(error))]
                for column, values in zip(out, zip(*rows)):
                    column += values
            yield _batch(*out, [b.schema.field(0).type, b.schema.field(2).type.value_type])

    return pools.mapInArrow(run, _schema(ranked))


def applied(ranked: DataFrame, answers: DataFrame, top_k: int) -> DataFrame:
    """``ranked`` in the order of the answers, with reranked and rerank_error (of the query); equal scores stay in the order of before."""
    a = saved(answers, "answers")
    failed = a.where("error is not null").groupBy("query_id").agg(F.min("error").alias("rerank_error"))
    both = ranked.join(a.where("error is null").select("query_id", "chunk_id", "new"), ["query_id", "chunk_id"], "left").join(failed, "query_id", "left")
    both = both.withColumn("new", F.when(F.col("rerank_error").isNull(), F.col("new")))
    return fusion.reranked(both, top_k, ties="rank")


def model_scorer(model, **options) -> Callable[[DataFrame, int], DataFrame]:
    """For ``search``: reranks by a model in batches."""
    return lambda ranked, top_k: applied(ranked, by_model(ranked, model, top_k, **options), top_k)


def service_scorer(service, **options) -> Callable[[DataFrame, int], DataFrame]:
    """For ``search``: reranks by a service, a call a query."""
    return lambda ranked, top_k: applied(ranked, by_service(ranked, service, top_k, **options), top_k)


def column_scorer(scorer: Callable[[Column, Column], Column]) -> Callable[[DataFrame, int], DataFrame]:
    """For ``search``: reranks by a column of the query and the text."""
    return lambda ranked, top_k: fusion.rerank(ranked, scorer, top_k)
