"""A training-data pipeline: quality, language, near-duplicates, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and
read again as the next stage's docs. All but the last return the columns of documents.

Defined results, for every stage: an empty table gives no rows; further columns, whatever they are
called, stay with their rows; texts of any length are taken whole; what a stage says of null and empty
texts, null ids, repeated rows and ties is in its docstring.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from stackwise.llm import langid, mixing, packing, quality, simhash
from stackwise.session import saved, table

#: A document stays if one language has at least so much of it.
LEAST_SHARE = 0.5


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labels of docs, does not reject.

    Null and empty texts have the score of no feature, and go or stay together; rows without an id or a
    label are scored like others; repeated rows go or stay together; a score of exactly 0.5 stays.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs.select(F.struct("*").alias("kept"), "text"), model, ["kept"]).where("score >= 0.5").select("kept.*")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: not those without a letter, nor those of many languages with no main one.

    So null and empty texts go; rows without an id or a lang are told like others; repeated rows go or
    stay together; of equal shares the language first by code point is the main one.
    """
    found = langid.predict(docs.select(F.struct("*").alias("kept"), "text"), langid.fit(docs), ["kept"])
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SHARE)).select("kept.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more).

    That of the smallest id stays, of repeated ids and rows one; texts without a word are copies of each
    other; rows without an id all stay.
    """
    return simhash.deduplicated(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as the mixture takes them, repeats included, in order of training position.

    Texts without a word go; a null source is a source; rows without an id, and rows that repeat one, have
    places of their own in the queue.
    """
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences: of every row, repeats included; null texts, ids and sources as ``packing`` says."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality_stage), ("language", language_stage), ("near_duplicates", near_duplicate_stage), ("mixing", mixing_stage), ("packing", packing_stage)]

#: The classifiers, fingerprints and tokens of the stages are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
