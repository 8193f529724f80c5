"""Vectors in columns: validity, the closed set of exact copies, and Arrow lists as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(column: str, dim: int | Column) -> Column:
    """Whether a vector has dim numbers, none of them null, NaN or infinite, and is not all zero."""
    v = F.col(column)
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(v) == dim) & ~odd & F.exists(v, lambda x: x != 0), F.lit(False))


def one_per_id(df: DataFrame, dim: int, *columns: str) -> DataFrame:
    """id, embedding and the given columns of each id's latest row (by updated_at, then by content) with a usable
    embedding; ids that are null are left out."""
    kept = df.where(F.col("id").isNotNull() & usable("embedding", dim))
    best = F.max_by(F.struct("embedding", *columns), F.struct("updated_at", F.xxhash64("embedding", *columns)))
    return kept.groupBy("id").agg(best.alias("r")).select("id", "r.*")


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """An Arrow list column, each list of dim numbers, as a matrix."""
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float32).reshape(-1, dim)


def unit(m: np.ndarray) -> np.ndarray:
    wide = m.astype(np.float64)
    return (wide / np.linalg.norm(wide, axis=1, keepdims=True)).astype(np.float32)


def lists(m: np.ndarray, kind: pa.DataType | None = None) -> pa.ListArray:
    ends = np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]
    return pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(m).ravel(), kind))
