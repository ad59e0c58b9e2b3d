"""Shards of home rows and visitors, and local unions of links."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from stackwise.session import saved

#: Home rows, and visitors, of a shard in one task; of larger shards every task gets two parts of so many rows.
MOST = 8192


def tasks_of(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def dealt(assigned: DataFrame, key: str, most: int = MOST, weight: Column | None = None, most_weight: int = 1) -> DataFrame:
    """``assigned`` (shard, home, and the column ``key``) with part and cross, so that every pair of a shard with a home row in it meets in one (shard, part).

    A large shard's home rows and visitors are cut in parts by a hash of the key, of about ``most`` rows
    and a sum of ``weight`` of about ``most_weight`` at most. There is a task
    for each home part alone, for two home parts (the second as visitors), and for a home part with
    a part of the visitors; in the last two, ``cross``, only home rows and visitors are to be
    compared. Only the large shards' names and sizes are joined. The result is dealt by shard and part, as
    the join may leave all parts of a shard in one task, to a stated number of tasks: rows are few bytes
    for the comparisons that they take, and are not to be coalesced by bytes.
    """
    rows = lambda mine: F.ceil(F.count_if(mine) / most)
    parts = rows if weight is None else lambda mine: F.greatest(rows(mine), F.ceil(F.coalesce(F.sum(F.when(mine, weight)), F.lit(0)) / most_weight))
    counts = assigned.groupBy("shard").agg(parts(F.col("home")).alias("hp"), parts(~F.col("home")).alias("vp")).where("hp > 1 or vp > 1")
    large = counts.select("shard", F.greatest(F.lit(1), "hp").cast("long").alias("hp"), F.col("vp").cast("long").alias("vp"))
    task = lambda part, home, cross: F.struct(part.cast("long").alias("part"), home.alias("home"), cross.alias("cross"))
    upto = lambda n, f: F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(n - 1, F.lit(0))), f)).otherwise(F.array().cast("array<struct<part:bigint,home:boolean,cross:boolean>>"))
    hp, vp = F.col("hp"), F.col("vp")
    i, v = F.pmod(F.xxhash64(key, F.lit(1)), hp), F.pmod(F.xxhash64(key, F.lit(2)), F.greatest(vp, F.lit(1)))
    of_home = F.concat(upto(hp, lambda j: task(F.least(i, j) * hp + F.greatest(i, j), j >= i, i != j)), upto(vp, lambda j: task(hp * hp + i * vp + j, F.lit(True), F.lit(True))))
    of_visitor = upto(hp, lambda j: task(hp * hp + j * vp + v, F.lit(False), F.lit(True)))
    tasks = F.when(hp.isNull(), F.array(task(F.lit(0), F.col("home"), F.lit(False)))).when(F.col("home"), of_home).otherwise(of_visitor)
    # written, so that its size is known and a small one is broadcast: few shards are large
    out = assigned.join(saved(large, "large"), "shard", "left").withColumn("task", F.explode(tasks))
    return out.withColumn("home", F.col("task.home")).withColumn("part", F.col("task.part")).withColumn("cross", F.col("task.cross")).drop("hp", "vp", "task").repartition(tasks_of(assigned), "shard", "part")


class Unions:
    """Disjoint sets over 0..n-1, merged by arrays of pairs; a set's name is its smallest member."""

    def __init__(self, n: int):
        self.name = np.arange(n)

    def merge(self, a: np.ndarray, b: np.ndarray) -> None:
        name = self.name
        while len(a):
            x, y = name[a], name[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(name, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = name[name]
                if (up == name).all():
                    break
                name[:] = up

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """A spanning star of every set of two or more."""
        at = np.flatnonzero(self.name != np.arange(len(self.name)))
        return at, self.name[at]
