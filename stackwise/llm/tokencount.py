"""Token counts of a byte-fallback piece vocabulary, by heap-and-linked-list pair merging.

A text is cut into segments that no merge can cross, the symbols of a segment form a
doubly linked list, and a heap hands out the lowest-ranked adjacent pair again and again.
The count is the number of initial symbols less the merges made (plus the extra bytes of
characters that have no piece); no identifier is ever produced.

Defined results: null text counts as empty: zero bytes, zero tokens; a null id stays null; repeated
rows are counted one by one; of equal ranks the pair further left is merged first, as the library
does; a text of any length is counted whole, segment by segment (a segment without any white space
takes some hundred bytes a character while it is merged); an empty table gives no rows; other
columns are ignored, whatever they are called.
"""

from __future__ import annotations

import heapq
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stackwise.llm.common import WordCache
from stackwise.session import ship

SPACE = "▁"
_counters: dict[str, "PairMerger"] = {}


class PairMerger:
    """Counts by merging; ``ranks`` maps a piece to its rank, lower merges first."""

    def __init__(self, ranks: dict[str, int], known: set[str], cross: frozenset[str] = frozenset()):
        self.ranks, self.known = ranks, known
        self.cache = WordCache(self.merge)
        self.fast = not cross
        self.cut = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")

    @classmethod
    def load(cls, path: str) -> "PairMerger":
        from sentencepiece import sentencepiece_model_pb2 as model

        proto = model.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        normal = [(p.piece, p.score) for p in proto.pieces if p.type == 1]
        order = sorted(range(len(normal)), key=lambda i: -normal[i][1])
        ranks = {normal[i][0]: k for k, i in enumerate(order)}
        # pieces with a space after another character, or with a line end, would join segments
        cross = frozenset(p for p in ranks if SPACE in p.lstrip(SPACE) or "\n" in p)
        return cls(ranks, {p for p in ranks if len(p) == 1}, cross)

    def merge(self, segment: str) -> int:
        """Tokens of one segment."""
        n = len(segment)
        ranks = self.ranks
        if n == 1:
            return 1 if segment in self.known else len(segment.encode("utf-8", "surrogatepass"))
        piece = list(segment)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []
        for i in range(n - 1):
            r = ranks.get(segment[i : i + 2])
            if r is not None:
                heap.append((r, i, 2))
        heapq.heapify(heap)
        merges = 0
        while heap:
            r, i, size = heapq.heappop(heap)
            a = piece[i]
            if not a:
                continue
            j = right[i]
            if j >= n or len(a) + len(piece[j]) != size or ranks.get(a + piece[j]) != r:
                continue
            both = a + piece[j]
            piece[i], piece[j] = both, ""
            k = right[i] = right[j]
            merges += 1
            if k < n:
                left[k] = i
                r = ranks.get(both + piece[k])
                if r is not None:
                    heapq.heappush(heap, (r, i, size + len(piece[k])))
            h = left[i]
            if h >= 0:
                r = ranks.get(piece[h] + both)
                if r is not None:
                    heapq.heappush(heap, (r, h, len(piece[h]) + size))
        extra = sum(len(p.encode("utf-8", "surrogatepass")) - 1 for p in piece if len(p) == 1 and p not in self.known)
        return n - merges + extra

    def count(self, text: str) -> int:
        if not text:
            return 0
        text = SPACE + text.replace(" ", SPACE)
        if not self.fast:
            return self.merge(text)
        return sum(map(self.cache.__getitem__, self.cut.findall(text)))


def counter(path: str) -> PairMerger:
    if path not in _counters:
        _counters[path] = PairMerger.load(path)
    return _counters[path]


def count_tokens(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """``id_col``, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row."""
    ship(df.sparkSession)
    kind = df.schema[id_col].dataType

    def run(batches):
        merger = counter(model_path)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            tokens = [merger.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()), pa.array(tokens, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"id {kind.simpleString()}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > F.lit(limit)).alias("over_limit"))
