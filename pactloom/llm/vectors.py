"""What embedding operators share: which vectors take part, exact copies, inner products in double precision."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vec: Column) -> Column:
    """Not null or empty, no null or non-finite component, not all zero."""
    odd = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vec.isNotNull() & (F.size(vec) > 0) & ~odd & F.exists(vec, lambda x: x != 0), F.lit(False))


def with_key(df: DataFrame, vec_col: str) -> DataFrame:
    """Adds k, 96 bits of hash: equal vectors have equal keys."""
    return df.withColumn("k", F.struct(F.xxhash64(vec_col).alias("a"), F.hash(vec_col).alias("b")))


def common_size(df: DataFrame, vec_col: str) -> int:
    """The most frequent length; vectors of another length can't be compared with these."""
    row = df.groupBy(F.size(vec_col).alias("n")).count().orderBy(F.desc("count"), "n").first()
    return int(row["n"]) if row else 0


def matrix(cells, dtype=np.float64) -> np.ndarray:
    return np.array([np.asarray(x, dtype) for x in cells], dtype).reshape(len(cells), -1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row inner products; the sum's order doesn't depend on the other rows."""
    return np.einsum("ij,ij->i", np.ascontiguousarray(a, np.float64), np.ascontiguousarray(b, np.float64))
