"""Language identification with mixtures of languages.

A language is a table of log probabilities of hashed character 2- and 3-grams, counted on a
bounded sample of labelled documents (about ``sample`` in all and at most four times as many,
of at most ``MOST_CHARS`` characters each, shared evenly by all languages that there are; the rows come
in order of a hash of the id, the id and a hash of the text; with over 256 languages the table has
fewer buckets, and with more languages than ``sample`` one document of each is taken). A word's log likelihood in a language sums those of its n-grams; a document is a mixture of
languages over its words, and expectation maximisation estimates the proportions. The set of
languages is selected by penalised likelihood: the nested sets of the largest proportions are
fitted again, and the set with the highest log likelihood - penalty * size * log(words) stays.
Of a very long text the likelihoods are made piece by piece; what stays is one number a word and
language.

Defined results: null text, and text without a letter, is ``und`` with score 0; ties go to
the language first by code point; without any labelled text all is ``und``. Repeated rows
give the same result; an empty table gives no rows; other columns are ignored, whatever they are
called.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from stackwise.llm.common import PIECE_CHARS, batches_of_text, pieces_of, release_unused
from stackwise.llm.ngrams import Grams
from stackwise.session import saved, ship

BUCKETS_LOG2 = 17
#: The bound of the training sample, documents in all.
SAMPLE = 4000
#: The bound of a text in it.
MOST_CHARS = 200_000
#: Cells of the table of buckets and languages: with over 256 languages there are fewer buckets, so that all languages are learned.
CELLS_LOG2 = 25
#: Languages whose rates are broadcast; of more, they are joined by a shuffle.
MOST_BROADCAST = 100_000
ORDERS = (2, 3)
_PLAIN = re.compile("[A-Za-z]")
UNKNOWN = "und"


def has_letter(text: str) -> bool:
    """Letters of any script; not numbers such as a half, nor signs."""
    return _PLAIN.search(text) is not None or any(map(str.isalpha, text))


class Languages:
    """``names``, and ``table`` [bucket, language] of log probabilities."""

    def __init__(self, names: list[str], table: np.ndarray, rounds: int = 6, penalty: float = 2.0):
        self.names, self.table, self.rounds, self.penalty = names, table, rounds, penalty

    def likelihoods(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log likelihood [word, language] of every word, and its text."""
        if len(texts) == 1 and len(texts[0]) > PIECE_CHARS:
            logs = np.concatenate([self.likelihoods([x])[0] for x in pieces_of(texts[0])])
            return logs, np.zeros(len(logs), dtype=np.int64)
        g = Grams([t.lower() for t in texts])
        total = np.zeros((len(g.starts), len(self.names)), dtype=np.float32)
        shift = np.uint32(33 - len(self.table).bit_length())
        for n in ORDERS:
            h, word = g.gram(n)
            if len(word):
                at = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
                total[word[at]] += np.add.reduceat(self.table[h >> shift], at, axis=0)
        return total, g.word_doc

    def fitted(self, like: np.ndarray, starts: np.ndarray, of: np.ndarray, n: np.ndarray, shares: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
        """Shares after so many rounds of expectation and maximisation, and the log likelihood of each text (less a part that all sets share)."""
        for _ in range(rounds):
            r = like * shares[of]
            r /= np.maximum(r.sum(1, keepdims=True), 1e-30)
            shares = np.add.reduceat(r, starts, axis=0) / n[:, None]
        return shares, np.add.reduceat(np.log(np.maximum((like * shares[of]).sum(1), 1e-30)), starts)

    def mixtures(self, texts: list[str]) -> np.ndarray:
        """Shares [text, language]; all zero for a text of no letter."""
        size = len(self.names)
        out = np.zeros((len(texts), size), dtype=np.float64)
        some = [i for i, t in enumerate(texts) if has_letter(t)]
        if not some or not size:
            return out
        logs, of = self.likelihoods([texts[i] for i in some])
        starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        n = np.diff(np.r_[starts, len(of)]).astype(np.float32)
        like = np.exp(logs - logs.max(1, keepdims=True))
        shares, _ = self.fitted(like, starts, of, n, np.full((len(some), size), 1 / size, dtype=np.float32), self.rounds)
        # nested sets of the largest shares, for the texts whose second share counts at all
        order = np.argsort(-shares, axis=1, kind="stable")
        rank = np.argsort(order, axis=1, kind="stable")
        pick = np.flatnonzero(np.sort(shares, axis=1)[:, -2] >= 0.005) if size > 1 else np.zeros(0, int)
        best = np.where(rank == 0, np.float32(1), np.float32(0))
        if len(pick):
            inside = np.isin(of, pick)
            like, sub = like[inside], np.searchsorted(pick, of[inside])
            sub_starts = np.flatnonzero(np.r_[True, sub[1:] != sub[:-1]])
            k = int((shares[pick] >= 0.005).sum(1).max())
            top = np.full(len(pick), -np.inf)
            for m in range(1, k + 1):
                first = np.where(rank[pick] < m, shares[pick], 0)
                first /= np.maximum(first.sum(1, keepdims=True), 1e-30)
                s, ll = self.fitted(like, sub_starts, sub, n[pick], first, 0 if m == 1 else self.rounds // 2)
                value = ll - self.penalty * m * np.log(n[pick] + 1)
                better = value > top
                top[better] = value[better]
                best[pick[better]] = s[better]
        out[some] = best
        return out


def learn(rows: dict[str, list[str]], **options) -> Languages:
    names = sorted(rows)
    bits = min(BUCKETS_LOG2, max(10, CELLS_LOG2 - max(0, len(names) - 1).bit_length()))
    counts = np.zeros((1 << bits, len(names)))
    shift = np.uint32(32 - bits)
    for j, name in enumerate(names):
        for _, part in batches_of_text(rows[name]):
            g = Grams([t.lower() for t in part])
            for n in ORDERS:
                counts[:, j] += np.bincount(g.gram(n)[0] >> shift, minlength=1 << bits)
    smooth = 0.05
    table = np.log((counts + smooth) / (counts.sum(0) + smooth * len(counts)))
    return Languages(names, table.astype(np.float32), **options)


def in_fold(doc_id: Column, of: int, fold: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(of)) == fold


def fit(documents: DataFrame, sample: int = SAMPLE, **options) -> Languages:
    """From text and non-null lang of ``documents``; a hash of the id takes about the same number of each language."""
    known = documents.where("lang is not null and text is not null").where(F.length("text") <= MOST_CHARS)
    counts = saved(known.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    languages = counts.count()
    if not languages:
        return learn({}, **options)
    each, scale = max(1, sample // languages), 1 << 20
    # one row a language
    rates = counts.select("lang", F.least(F.lit(scale), F.ceil(F.lit(scale * each) / F.col("n"))).alias("rate"))
    known = known.select("doc_id", "lang", "text").join(F.broadcast(rates) if languages <= MOST_BROADCAST else rates, "lang")
    picked = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(scale)) < F.col("rate")).select("doc_id", "lang", "text").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"), "lang").limit(4 * max(sample, languages)).toArrow()
    picked = picked.sort_by([("lang", "ascending"), ("doc_id", "ascending"), ("text", "ascending")])
    rows: dict[str, list[str]] = {}
    for lang, text in zip(picked["lang"].to_pylist(), picked["text"].to_pylist()):
        rows.setdefault(lang, []).append(text)
    model = learn(rows, **options)
    del rows, picked
    release_unused()
    return model


def predict(df: DataFrame, model: Languages, extra: list[str] | None = None) -> DataFrame:
    """The columns ``extra`` of ``df`` (by default all) with lang_pred, score (the language's share) and languages (array of lang, share); columns of these names are replaced."""
    ship(df.sparkSession)
    keep = [c for c in (df.columns if extra is None else extra) if c not in ("lang_pred", "score", "languages")]
    shared = df.sparkSession.sparkContext.broadcast((model.names, model.table, model.rounds, model.penalty))
    struct = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def run(batches):
        m = Languages(*shared.value)
        for b in batches:
            lang, score, sets = [], [], []
            for _, part in batches_of_text([t or "" for t in b.column(1).to_pylist()], 500_000 * 256 // max(256, len(m.names))):
                for row in m.mixtures(part):
                    if not row.any():
                        lang.append(UNKNOWN), score.append(0.0), sets.append([])
                        continue
                    order = np.argsort(-row, kind="stable")
                    lang.append(m.names[order[0]])
                    score.append(float(min(1.0, row[order[0]])))
                    sets.append([{"lang": m.names[j], "share": float(row[j])} for j in order if row[j] > 0])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(sets, struct)], names=["row", "lang_pred", "score", "languages"])

    rows = df.select(F.struct(*keep).alias("row"), F.col("text"))
    schema = T.StructType([rows.schema["row"]]).add("lang_pred", "string").add("score", "double").add("languages", T.ArrayType(T.StructType().add("lang", "string").add("share", "double")))
    return rows.mapInArrow(run, schema).select("row.*", "lang_pred", "score", "languages")


def identify(documents: DataFrame, folds: int = 5, held: int = 0, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score, languages of every document, learned outside the fold ``held``."""
    model = fit(documents.where(~in_fold(F.col("doc_id"), folds, held)), **options)
    out = predict(documents, model, ["doc_id"])
    return out.select("doc_id", in_fold(F.col("doc_id"), folds, held).alias("held_out"), "lang_pred", "score", "languages")
