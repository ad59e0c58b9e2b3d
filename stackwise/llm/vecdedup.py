"""Embedding near-duplicates by an inverted multi-index.

Vectors are scaled to length one and cut in halves; each half has a codebook of its own (k-means
on a bounded sample), and the products of the two are the cells of a grid. A vector is at home
in its nearest cell. It visits other cells in the order of its distance to them (multi-sequence
traversal: both codebooks sorted by distance, a heap of the pairs that may come next; it ends where
the sum of distances is above that of the home cell by more than a gap). The gap is set to reach the target recall: it is a
quantile of the gaps seen for pairs exactly at the threshold, made from the sample by turning
vectors by that angle in random directions, and for pairs in the sample itself. Of two cells, only
the one with the smaller number is visited, so a pair meets at most once. In a cell, home rows
are compared with each other and with visitors, in double precision: every link returned is
verified, and no pair is emitted - a row's links are counted, and links leave as a spanning star.

Equal vectors are one class with a count, so a vector that a third of all rows share is one row.
Codes grow with the square root of the rows, and the sample with the codes, up to ``MOST_SAMPLE``
vectors and ``MOST_SAMPLE`` / 32 codes a half (some 17 billion vectors at 1,024 a cell; beyond, cells
grow). Vectors of a length that few have are one cell, without an index.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link
with nothing (and keep their own id); so do rows without an id (null component); vectors of
different lengths do not link; repeated ids count as other vectors; an empty table gives no rows;
other columns are ignored, whatever they are called.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from stackwise.llm.components import components
from stackwise.llm.shards import Unions, dealt
from stackwise.session import saved, ship

#: The sample that codebooks are fitted on has so many vectors, or ``PER_CODE`` a code up to ``MOST_SAMPLE``; the gap is fitted on the first ``SAMPLE``.
SAMPLE = 8192
MOST_SAMPLE = 131_072
PER_CODE = 32
ROWS_PER_CELL = 1024
RECALL = 0.995
#: Rows of a cell's part: what a task compares at a time.
MOST_ROWS = 4096


def codes_for(n: int) -> int:
    """Codes of each half for n vectors."""
    return int(min(MOST_SAMPLE // PER_CODE, max(1, round(np.sqrt(n / ROWS_PER_CELL)))))


def nearest(x: np.ndarray, centres: np.ndarray, step: int = 2048) -> np.ndarray:
    return np.concatenate([distances(x[i : i + step], centres).argmin(1) for i in range(0, len(x), step)])


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds if len(centres) > 1 else 1):
        near = nearest(x, centres)
        order = np.argsort(near, kind="stable")
        own, first, n = np.unique(near[order], return_index=True, return_counts=True)
        centres[own] = np.add.reduceat(x[order], first, axis=0) / n[:, None]
    return centres


def nearest_cells(first: np.ndarray, second: np.ndarray, gap: float):
    """Multi-sequence traversal: (i, j, distance) in order of first[i] + second[j], both ascending from 0, up to the gap."""
    heap = [(0.0, 0, 0)]
    while heap:
        at, i, j = heapq.heappop(heap)
        if at > gap:
            return
        yield i, j, at
        if j + 1 < len(second):
            heapq.heappush(heap, (first[i] + second[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(first):
            heapq.heappush(heap, (first[i + 1], i + 1, 0))


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None])


def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = x / np.sqrt((x * x).sum(1))[:, None]
    cut = max(1, x.shape[1] // 2)
    return x[:, :cut], x[:, cut:]


class Index:
    """The grid for vectors of one length."""

    def __init__(self, first: np.ndarray, second: np.ndarray, gap: float):
        self.first, self.second, self.gap = first, second, gap

    @classmethod
    def fitted(cls, sample: np.ndarray, n: int, threshold: float, recall: float, seed: int = 1) -> "Index":
        a, b = halves(sample)
        k = min(codes_for(n), len(sample))
        index = cls(kmeans(a, k, seed), kmeans(b, k, seed + 1), 0.0)
        rng = np.random.default_rng(seed)
        x = np.concatenate([a, b], axis=1)[:SAMPLE]
        gaps = []
        turn = rng.standard_normal(x.shape)
        turn -= (turn * x).sum(1)[:, None] * x
        turn /= np.maximum(np.sqrt((turn * turn).sum(1)), 1e-12)[:, None]
        gaps.append(index.gaps(x, threshold * x + np.sqrt(1 - threshold**2) * turn))
        for i in range(0, len(x), 512):
            p, q = np.nonzero(x[i : i + 512] @ x[i:].T >= threshold)
            apart = q > p
            if apart.any():
                gaps.append(index.gaps(x[i + p[apart]][:100_000], x[i + q[apart]][:100_000]))
        index.gap = float(max(np.quantile(g, recall) for g in gaps)) + 1e-9
        return index

    def costs(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = halves(x)
        return distances(a, self.first), distances(b, self.second) if b.shape[1] else np.zeros((len(a), len(self.second)))

    def gaps(self, x: np.ndarray, y: np.ndarray, step: int = 1024) -> np.ndarray:
        """How much farther than its home the vector in the larger cell is from the home cell of the other."""
        out = []
        width = len(self.second)
        for s in range(0, len(x), step):
            (xa, xb), (ya, yb) = self.costs(x[s : s + step]), self.costs(y[s : s + step])
            at = np.arange(len(xa))
            hx, hy = xa.argmin(1) * width + xb.argmin(1), ya.argmin(1) * width + yb.argmin(1)
            of_x = xa[at, hy // width] + xb[at, hy % width] - xa.min(1) - xb.min(1)
            of_y = ya[at, hx // width] + yb[at, hx % width] - ya.min(1) - yb.min(1)
            out.append(np.where(hx == hy, 0, np.where(hx > hy, of_x, of_y)))
        return np.concatenate(out)

    def places(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, cells and whether the row is at home there; visitors come from larger cells only."""
        da, db = self.costs(x)
        width = len(self.second)
        home = da.argmin(1) * width + db.argmin(1)
        rows, cells = list(range(len(x))), home.tolist()
        da -= da.min(1, keepdims=True)
        db -= db.min(1, keepdims=True)
        for r in range(len(x)) if len(self.first) * width > 1 else ():
            a, b = np.flatnonzero(da[r] <= self.gap), np.flatnonzero(db[r] <= self.gap)
            a, b = a[np.argsort(da[r, a], kind="stable")], b[np.argsort(db[r, b], kind="stable")]
            if len(a) * len(b) == 1:
                continue
            codes_a, codes_b, own = a.tolist(), b.tolist(), cells[r]
            for i, j, _ in nearest_cells(da[r, a].tolist(), db[r, b].tolist(), self.gap):
                cell = codes_a[i] * width + codes_b[j]
                if cell < own:
                    rows.append(r), cells.append(cell)
        at_home = np.zeros(len(rows), bool)
        at_home[: len(x)] = True
        return np.array(rows, dtype=np.int64), np.array(cells, dtype=np.int64), at_home


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(flat), -1)


def usable(v: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, finite) & F.exists(v, lambda x: x != 0)


def neighbours(classes: DataFrame, threshold: float, recall: float) -> DataFrame:
    """Of classes (id, n, v): rows (id, links, b): links found in one cell, and a spanning link to b (or null)."""
    spark = ship(classes.sparkSession)
    # lengths that few vectors have are one cell each: only those of many need an index, and a job of its sample
    sizes = {r["w"]: r["count"] for r in classes.groupBy(F.size("v").alias("w")).count().where(F.col("count") >= 2 * ROWS_PER_CELL).collect()}
    indexes = {}
    for w, n in sizes.items():
        most = max(SAMPLE, PER_CODE * codes_for(n))
        sample = classes.where(F.size("v") == w).select("id", "v").orderBy(F.xxhash64("id"), "id").limit(most).toArrow()
        indexes[w] = Index.fitted(_matrix(sample["v"]), n, threshold, recall)
    shared = spark.sparkContext.broadcast(indexes)

    def assign(batches):
        for b in batches:
            width = np.array([len(v) for v in b.column(2)])
            for w in np.unique(width):
                at = np.flatnonzero(width == w)
                part = b.take(pa.array(at))
                index = shared.value.get(int(w))
                rows, cells, home = index.places(_matrix(part.column(2))) if index else (np.arange(len(at)), np.zeros(len(at), np.int64), np.ones(len(at), bool))
                for i in range(0, len(rows), 20_000):
                    pick = pa.array(rows[i : i + 20_000])
                    yield pa.RecordBatch.from_arrays([pa.array(cells[i : i + 20_000].astype(np.int64) + (int(w) << 32)), pa.array(home[i : i + 20_000]), *(c.take(pick) for c in part.columns)], names=["shard", "home", "id", "n", "v"])

    def meet(t: pa.Table) -> pa.Table:
        home = t["home"].to_numpy()
        order = np.argsort(~home, kind="stable")
        homes, ids, n = int(home.sum()), t["id"].to_numpy()[order], t["n"].to_numpy()[order]
        x = _matrix(t["v"])[order]
        length = np.sqrt((x * x).sum(1))
        counts, union = np.zeros(len(x), dtype=np.int64), Unions(len(x))
        cross = t["cross"][0].as_py()
        for i in range(0, homes, 512):
            stop = min(i + 512, homes)
            other = homes if cross else i
            p, q = np.nonzero((x[i:stop] @ x[other:].T) / (length[i:stop, None] * length[None, other:]) >= threshold)
            p, q = i + p, other + q
            once = q > p
            p, q = p[once], q[once]
            counts += np.bincount(p, weights=n[q], minlength=len(x)).astype(np.int64) + np.bincount(q, weights=n[p], minlength=len(x)).astype(np.int64)
            union.merge(p, q)
        some = np.flatnonzero(counts)
        root = union.name[some]
        return pa.table([pa.array(ids[some]), pa.array(counts[some]), pa.array(ids[root], mask=root == some)], names=["id", "links", "b"])

    assigned = saved(classes.mapInArrow(assign, "shard long, home boolean, id long, n long, v " + classes.schema["v"].dataType.simpleString()), "cells")
    return dealt(assigned, "id", MOST_ROWS).groupBy("shard", "part").applyInArrow(meet, "id long, links long, b long")


def near_duplicates(df: DataFrame, threshold: float = 0.9, recall: float = RECALL, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id_col, n_links, component_id, kept of every row of ``df``."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    linkable = F.col("id").isNotNull() & usable(F.col("v"))
    classes = saved(rows.where(linkable).groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("n")).select("id", "n", "v"), "vectors")
    met = saved(neighbours(classes, threshold, recall), "links")
    found = components(met.where("b is not null").select(F.col("id").alias("a"), "b"))
    counts = met.groupBy("id").agg(F.sum("links").alias("links"))
    classes = classes.join(counts, "id", "left").join(found.withColumnRenamed("node", "id"), "id", "left")
    classes = classes.select("v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "id").alias("component"))
    out = rows.withColumn("ok", linkable).join(classes.withColumn("ok", F.lit(True)), ["v", "ok"], "left")
    out = out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
