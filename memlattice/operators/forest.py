"""Isolation forest: trees grown on bounded samples, all rows scored in parallel."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TREES, SAMPLE = 100, 256


def path_length(n: float) -> float:
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def grow(m: np.ndarray, draw: np.random.Generator, depth: int) -> tuple:
    """(column, limit, left, right), or the expected rest of the path in a leaf."""
    wide = np.flatnonzero(m.max(axis=0) > m.min(axis=0)) if len(m) > 1 else []
    if depth == 0 or not len(wide):
        return (path_length(len(m)),)
    c = int(draw.choice(wide))
    limit = draw.uniform(m[:, c].min(), m[:, c].max())
    low = m[:, c] < limit
    return c, limit, grow(m[low], draw, depth - 1), grow(m[~low], draw, depth - 1)


def depths(tree: tuple, m: np.ndarray, at: float = 0.0) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(m), at + tree[0])
    out, low = np.empty(len(m)), m[:, tree[0]] < tree[1]
    out[low], out[~low] = depths(tree[2], m[low], at + 1), depths(tree[3], m[~low], at + 1)
    return out


def isolation_scores(df: DataFrame, id_column: str, features: list[str], trees: int = TREES, sample: int = SAMPLE, anomalous: float = 0.6) -> DataFrame:
    """id_column, the features, score (2 to the minus mean depth over the expected one) and whether it is anomalous.

    Each tree is grown on `sample` rows; these come from the trees * sample rows with the smallest hashes of their id,
    which is all that reaches the driver, whatever the number of rows. Null features count as 0. One row scores 0.
    """
    clean = df.select(id_column, *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features])
    drawn = clean.orderBy(F.xxhash64(id_column), id_column).limit(trees * sample).toPandas()[features].to_numpy(float)
    n = min(sample, len(drawn))
    forest = []
    for i in range(trees if n else 0):
        draw = np.random.default_rng(i)
        forest.append(grow(drawn[draw.permutation(len(drawn))[:n]], draw, max(1, int(np.ceil(np.log2(max(n, 2)))))))
    sent = df.sparkSession.sparkContext.broadcast(forest)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            m = b[features].to_numpy(float)
            mean = np.mean([depths(t, m) for t in sent.value], axis=0) if len(m) else np.zeros(0)
            b["score"] = 2 ** (-mean / path_length(n)) if n > 1 else 0.0
            b["anomalous"] = b.score >= anomalous
            yield b

    kind = df.schema[id_column].dataType.simpleString()
    return clean.mapInPandas(score, f"`{id_column}` {kind}, " + ", ".join(f"`{f}` double" for f in features) + ", score double, anomalous boolean")
