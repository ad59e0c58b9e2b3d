"""Connected components of a graph of links, without collecting it anywhere.

Alternating large-star and small-star steps: every step replaces a link by one to the smallest
neighbour, until every component is a star around its smallest node. Minima are aggregated
before they are shuffled, and joins against a popular node are ones the engine can split; each
step is written to the shared folder, which cuts the lineage.

Defined results: links of a node with itself, and links with a null end, are left out; repeated links
count once; no links give no rows; other columns are ignored, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stackwise.session import discard, saved

MOST_STEPS = 60


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """links (u, v) with u > v -> the same after one step."""
    if large:
        both = links.select(F.col("u").alias("n"), F.col("v").alias("x")).unionByName(links.select(F.col("v").alias("n"), F.col("u").alias("x")))
    else:
        both = links.select(F.col("u").alias("n"), F.col("v").alias("x"))
    least = both.groupBy("n").agg(F.least(F.min("x"), F.col("n")).alias("m"))
    joined = both.join(least, "n")
    if large:
        out = joined.where("x > n").select(F.col("x").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("x").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("n").alias("u"), F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(links: DataFrame, tag: str = "components") -> DataFrame:
    """node, component (the smallest node reachable) of every node that has a link; ``links`` are longs (a, b)."""
    e = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = saved(e, tag)
    mark = lambda d: tuple(d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    now = mark(e)
    for _ in range(MOST_STEPS):
        if not now[0]:
            break
        last, e = e, saved(_stars(_stars(e, True), False), tag)
        discard(last)
        before, now = now, mark(e)
        if now == before:
            break
    else:
        raise RuntimeError("the components did not settle")
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
