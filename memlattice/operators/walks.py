"""Walks over the memory graph, many at once: each step is a join of the walkers with their edges, not a walk of its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memlattice.operators.retrieval import nearest
from memlattice.tables import materialize


def drawn(*key: Column) -> Column:
    """A number from 0 up to 1 that only depends on the key, by its MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *key)), 1, 8), 16, 10).cast("double") / 2**32


def weighted_pick(rows: DataFrame, by: list[str], weight: str, order: list[str], draw: Column) -> DataFrame:
    """One row of each group, with a probability by weight: the first at which the sum of weights reaches the drawn share
    of their total."""
    w = Window.partitionBy(*by)
    upto = F.sum(weight).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    reached = rows.withColumns({"_upto": upto, "_total": F.sum(weight).over(w), "_draw": draw}).where(F.col("_upto") >= F.col("_draw") * F.col("_total"))
    return reached.withColumn("_n", F.row_number().over(w.orderBy(*order))).where("_n = 1").drop("_upto", "_total", "_draw", "_n")


def walks(scores: DataFrame, edges: DataFrame, walkers: int = 10, steps: int = 3, seeds: int = 10, draw: Callable[..., Column] = drawn) -> DataFrame:
    """walk, step, id, score: walks that begin at one of the `seeds` memories with the highest score, picked by score,
    and go on along edges to memories that they have not visited, picked by 0.4 of the edge's weight and 0.6 of the
    memory's score. A walk ends early where there is no such edge. scores: id, score. edges: id, source_id, target_id,
    weight."""
    spark = scores.sparkSession
    pool = materialize(scores.where("score is not null").orderBy(F.desc("score"), "id").limit(seeds), "pool")
    walk = spark.range(walkers).select(F.col("id").cast("int").alias("walk"))
    at = weighted_pick(walk.crossJoin(F.broadcast(pool)), ["walk"], "score", ["id"], draw(F.col("walk"), F.lit(0)))  # walkers x seeds rows
    at = materialize(at.select("walk", F.lit(0).alias("step"), "id", "score", F.array("id").alias("path")), "walk")
    out = at
    for step in range(1, steps + 1):
        ways = at.select("walk", F.col("id").alias("source_id"), "path").join(edges.select(F.col("id").alias("edge"), "source_id", "target_id", "weight"), "source_id").where(~F.array_contains("path", F.col("target_id")))
        ways = ways.join(scores.select(F.col("id").alias("target_id"), F.col("score").alias("s")), "target_id").withColumn("score", 0.4 * F.col("weight") + 0.6 * F.col("s"))
        at = weighted_pick(ways, ["walk"], "score", ["edge"], draw(F.col("walk"), F.lit(step)))
        at = materialize(at.select("walk", F.lit(step).alias("step"), F.col("target_id").alias("id"), "score", F.concat("path", F.array("target_id")).alias("path")), "walk")
        out = out.unionByName(at)
    return out.drop("path")


def similarity_walk(rows: DataFrame, start: DataFrame, steps: int = 5) -> DataFrame:
    """step, id, score: from the row nearest to a vector (one row with `query`) on to the most similar one that was not
    visited, and so on; score is the cosine to the row before (to the vector for the first). rows: id, embedding."""
    found, at = None, start
    for step in range(steps):
        near = nearest(rows if found is None else rows.join(F.broadcast(found.select("id")), "id", "left_anti"), at, 1)  # `steps` rows
        one = materialize(near.select(F.lit(step).alias("step"), "id", "score", "embedding"), "walk")
        found = one if found is None else found.unionByName(one)
        at = one.select(F.col("embedding").alias("query"))
    return found.select("step", "id", "score")
