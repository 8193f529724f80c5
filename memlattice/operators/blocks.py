"""Comparing the rows of two tables that share a key, in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlattice.tables import materialize


def blockwise(left: DataFrame, right: DataFrame, keys: list[str], row: str, compare: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, block_rows: int) -> DataFrame:
    """compare(left block, right block) for each pair of blocks that together make up the rows of a key on both sides.

    A key's rows are cut into as many blocks, by the hash of `row`, as keep each near block_rows, so that a key with a
    third of all rows is many tasks. The counts by key (pre-aggregated) are written first, so that their size is known:
    while they are small, Spark sends them to all executors and no key's rows meet in one task before they are cut;
    beyond that it joins them by a shuffle, whose skewed partitions it splits.
    """
    left, right = left.toDF(*left.columns), right.toDF(*right.columns)  # columns of their own, if both are one table
    count = lambda side, name: side.groupBy(*keys).agg(F.ceil(F.count("*") / block_rows).cast("int").alias(name))
    n = materialize(count(left, "n_left").join(count(right, "n_right"), keys), "blocks")

    def spread(side: DataFrame, own: str, other: str, names: tuple[str, str]) -> DataFrame:
        block = F.pmod(F.xxhash64(row, F.lit("block")), F.col(own)).cast("int").alias(names[0])
        return side.join(n, keys).select(*side.columns, block, F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(names[1]))

    a = spread(left, "n_left", "n_right", ("block_l", "block_r")).groupBy(*keys, "block_l", "block_r")
    b = spread(right, "n_right", "n_left", ("block_r", "block_l")).groupBy(*keys, "block_l", "block_r")
    return a.cogroup(b).applyInPandas(compare, schema)
