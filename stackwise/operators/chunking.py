"""Chunking: budgets in tokens, blocks by structure, windows cut at the best break, refinement and semantic merging.

The sequential parts run as Arrow functions over whole documents; the separator mode without
windows is plain column expressions. Pieces that trim to nothing are dropped and the rest numbered.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types

from stackwise.functions import text as T
from stackwise.session import ship

_CJK = re.compile("[぀-ヿ㐀-䶿一-鿿가-힯]")
_HEADING = re.compile(r"(#{1,6})\s+(.+)")
_FENCE = re.compile(r"\s*(`{3,}|~{3,})")

# Classes of breaks with their scores; the sentence end cuts after its mark, the others before the line end.
BREAKS = (
    (r"\n#(?!#)", 100), (r"\n##(?!#)", 90), (r"\n###(?!#)", 80), (r"\n####(?!#)", 70), (r"\n#####(?!#)", 60), (r"\n######(?!#)", 50),
    (r"\n```", 80), (r"\n(?:---|\*\*\*|___)\s*\n", 60), (r"\n\n+", 20), (r"[。！？]", 8), (r"\n[-*]\s", 5), (r"\n\d+\.\s", 5), (r"\n", 1),
)
_BREAKS = tuple((re.compile(p), s, p.startswith("[")) for p, s in BREAKS)
WINDOW, DECAY = 0.22, 0.7
# Where a piece is split in two, in order of preference.
BOUNDARIES = ("\n\n", "。", "！", "？", "，", ", ", " ")
PIECES = types.ArrayType(types.StructType().add("idx", "integer").add("text", "string").add("heading", "string"))


def half_up(x: float) -> int:
    return math.floor(x + 0.5)


def normalize(text: str) -> str:
    return re.sub("\n{3,}", "\n\n", re.sub("\r\n?", "\n", text)).strip()


def est_tokens(text: str) -> int:
    cjk = len(_CJK.findall(text))
    return max(1, math.ceil(cjk / 1.5 + (len(text) - cjk) / 4))


def budget(text: str, size: int, overlap: int) -> tuple[int, int]:
    size = max(64, math.trunc(size))
    overlap = max(0, min(math.trunc(overlap), size - 1))
    per = len(text) / est_tokens(text)
    chars = max(64, half_up(size * per))
    return chars, min(half_up(overlap * per), chars - 1)


def blocks(text: str) -> list[tuple[str, str]]:
    """(block, heading path): paragraphs; a fenced block is one of its own up to a line of its mark alone; headings lead what follows."""
    out: list[tuple[str, str]] = []
    path: dict[int, str] = {}
    lines: list[str] = []
    fence = ""

    def flush() -> None:
        body = "\n".join(lines).strip()
        if body:
            out.append((body, " > ".join(path[k] for k in sorted(path))))
        lines.clear()

    for line in text.split("\n"):
        mark = _FENCE.match(line)
        if fence:
            lines.append(line)
            if mark and mark[1][0] == fence[0] and len(mark[1]) >= len(fence) and mark[1] == line.strip():
                fence = ""
            continue
        if mark:
            flush()
            fence = mark[1]
            lines.append(line)
            continue
        heading = _HEADING.fullmatch(line)
        if heading:
            flush()
            level = len(heading[1])
            path = {k: v for k, v in path.items() if k < level}
            path[level] = heading[2].strip()
        elif not line.strip():
            flush()
        else:
            lines.append(line)
    flush()
    return out


def best_cut(block: str, low: int, end: int) -> int:
    """The break of the highest decayed score in (low, end), earlier classes first among equals; end without one."""
    width = max(1, end - low)
    part = block[low:end]
    at, top = -1, -1.0
    for pattern, score, after in _BREAKS:
        for m in pattern.finditer(part):
            cut = low + (m.end() if after else m.start())
            value = score * DECAY ** ((end - cut) / width)
            if value > top:
                at, top = cut, value
    return at if at > low else end


def windows(block: str, size: int, overlap: int) -> Iterator[str]:
    start = 0
    while start + size < len(block):
        end = start + size
        low = max(start + 1, end - max(1, half_up(size * WINDOW)))
        cut = max(best_cut(block, low, end), start + 1)
        yield block[start:cut].strip()
        start = max(cut - overlap, start + 1)
    if start < len(block):
        yield block[start:].strip()


def separated(text: str, separator: str) -> list[str]:
    mark = separator.replace("\\n", "\n").replace("\\t", "\t") or "\n\n"
    return [p for p in (x.strip() for x in text.split(mark)) if p]


def chunk(text: str, size: int, overlap: int, smart: bool = True, separator: str = "") -> list[tuple[str, str]]:
    text = normalize(text)
    if not text:
        return []
    chars, over = budget(text, size, overlap)
    parts = blocks(text) if smart else [(p, "") for p in separated(text, separator)]
    out = [(w, h) for p, h in parts for w in ([p] if len(p) <= chars else windows(p, chars, over)) if w]
    return out or [(text[:chars], "")]


def split_point(text: str) -> tuple[str, str] | None:
    mid, reach = len(text) // 2, max(1, int(len(text) * 0.25))
    low, high = max(0, mid - reach), min(len(text), mid + reach)
    for mark in BOUNDARIES:
        at = text.rfind(mark, low, high)
        if at >= 0:
            left, right = text[: at + len(mark)].strip(), text[at + len(mark) :].strip()
            if left and right:
                return left, right
    return None


def refine(pieces: list[tuple[str, str]], limit: int, estimate: Callable[[str], int] = est_tokens) -> list[tuple[str, str]]:
    """Pieces over the limit (and of 40 characters or more) halved at a boundary, again and again; without a boundary they stay."""
    if limit <= 0:
        return list(pieces)
    out, todo = [], list(reversed(pieces))
    while todo:
        text, heading = todo.pop()
        halves = split_point(text) if estimate(text) > limit and len(text) >= 40 else None
        if halves is None:
            out.append((text, heading))
        else:
            todo += [(halves[1], heading), (halves[0], heading)]
    return out


def semantic_segments(text: str, separator: str = "") -> list[tuple[str, str]]:
    found = blocks(normalize(text))
    return [(p, h) for b, h in found for p in separated(b, separator)] if separator else found


def semantic_merge(segments: list[tuple[str, str]], vectors: list, size: int, least: float = 0.75) -> list[tuple[str, str, np.ndarray | None]]:
    """Neighbours joined while they fit the budget and are similar (a missing vector is similar to any).

    A chunk has the mean of its segments' vectors, weighed by the lengths of those that have one; a chunk
    whose first segment has none has none.
    """
    if not segments:
        return []
    chars, _ = budget("\n".join(s for s, _ in segments), size, 0)
    out: list[list] = []
    embedded = 0  # characters of the last chunk's segments that its vector is made of
    for (text, heading), v in zip(segments, vectors):
        v = None if v is None else np.asarray(v, dtype=float)
        last = out[-1] if out else None
        if last is not None and len(last[0]) + 1 + len(text) <= chars and alike(last[2], v) >= least:
            last[0] += "\n" + text
            if last[2] is not None and v is not None:
                mean = (last[2] * embedded + v * len(text)) / (embedded + len(text))
                length = np.linalg.norm(mean)
                last[2] = mean / length if length else mean
                embedded += len(text)
        else:
            out.append([text, heading, v])
            embedded = len(text)
    return [tuple(x) for x in out]


def alike(a: np.ndarray | None, b: np.ndarray | None) -> float:
    """The clamped cosine; 1 where a vector is missing, 0 where one has no length."""
    if a is None or b is None:
        return 1.0
    length = np.linalg.norm(a) * np.linalg.norm(b) if len(a) == len(b) else 0.0
    return float(np.clip(np.nan_to_num(a @ b / length), 0, 1)) if length else 0.0


def with_chunks(docs: DataFrame, size: int = 1024, overlap: int = 200, smart: bool = True, separator: str = "", limit: int = 0, text_col: str = "raw_text") -> DataFrame:
    """One row per chunk: the columns of ``docs`` without the text, and idx, text, heading."""
    ship(docs.sparkSession)
    keep = [c for c in docs.columns if c != text_col]
    kind = pa.list_(pa.struct([("idx", pa.int32()), ("text", pa.string()), ("heading", pa.string())]))

    def run(batches):
        for b in batches:
            found = [[{"idx": i, "text": t, "heading": h or None} for i, (t, h) in enumerate(refine(chunk(x, size, overlap, smart, separator), limit))] if x else [] for x in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, kind)], names=[*b.schema.names[:-1], "_pieces"])

    schema = docs.select(*keep).schema.add("_pieces", PIECES)
    out = docs.select(*keep, F.col(text_col).alias("_text")).mapInArrow(run, schema)
    return out.select(*keep, F.inline("_pieces"))


def delimiter_pieces(text: Column, separator: str) -> Column:
    """Separator mode as columns: trimmed parts that are not empty, in order."""
    mark = separator.replace("\\n", "\n").replace("\\t", "\t") or "\n\n"
    parts = F.split(T.normalize(text), "\\Q" + mark + "\\E")
    return F.filter(F.transform(parts, T.trimmed), lambda p: p != "")


def finished(chunks: DataFrame, model_tag: str | None = None) -> DataFrame:
    """chunks (base_id, doc_id, title, idx, text, heading) with chunk_id, context, search_text and the hash that vectors are stored under."""
    context = F.when(F.length("heading") > 0, F.concat("title", F.lit(" > "), "heading")).otherwise(F.col("title"))
    c = chunks.withColumn("context", context).withColumn("search_text", T.search_text(F.col("context"), F.col("text")))
    c = c.withColumn("chunk_id", F.sha2(F.concat_ws(":", "base_id", F.col("doc_id").cast("string"), F.col("idx").cast("string")), 256))
    return c.withColumn("embedding_text_hash", T.content_hash(F.col("search_text"))).withColumn("embedding_model", F.lit(model_tag).cast("string"))
