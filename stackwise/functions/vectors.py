"""Vector functions on array columns; sums in doubles, in the order of the components."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def clamped(score: Column) -> Column:
    return F.when(F.isnan(score) | score.isNull(), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def cosine(a: Column, b: Column) -> Column:
    """True cosine, 0 for unequal or zero vectors, clamped to [0, 1]."""
    length = norm(a) * norm(b)
    ok = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (length > 0)
    return F.when(ok, clamped(dot(a, b) / length)).otherwise(F.lit(0.0))


def unit_dot(a: Column, b: Column) -> Column:
    """For unit vectors: the product, clamped to [0, 1]."""
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), clamped(dot(a, b))).otherwise(F.lit(0.0))


def normalized(a: Column) -> Column:
    """Length one; the zero vector stays."""
    return F.when(norm(a) > 0, F.transform(a, lambda x: x.cast("double") / norm(a))).otherwise(F.transform(a, lambda x: x.cast("double")))


def weighted_mean(a: Column, wa: Column, b: Column, wb: Column) -> Column:
    return normalized(F.zip_with(a, b, lambda x, y: (x * wa + y * wb) / (wa + wb)))


def encoded(a: Column) -> Column:
    """Little-endian 32-bit floats, one after the other; null and empty vectors are null."""

    @F.pandas_udf("binary")
    def run(v: pd.Series) -> pd.Series:
        return v.map(lambda x: np.asarray(x, dtype="<f4").tobytes() if x is not None and len(x) else None)

    return run(a)


def decoded(c: Column) -> Column:
    """The vector of such bytes; null and empty bytes are null."""

    @F.pandas_udf("array<float>")
    def run(raw: pd.Series) -> pd.Series:
        return raw.map(lambda x: np.frombuffer(x, dtype="<f4") if x is not None and len(x) else None)

    return run(c)
