"""Graph operators over edges (source_id, target_id, relation, weight): degrees, orphans, breadth-first layers, algebraic
connectivity. Vertices and edges stay distributed; only vectors' sums and norms reach the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlattice.tables import materialize


def degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """id, degree of every vertex; an edge counts at both ends, a loop twice, an edge to an unknown id at the other."""
    ends = edges.select(F.explode(F.array("source_id", "target_id")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    return vertices.select("id").distinct().join(ends, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("bigint").alias("degree"))


def layers(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """id, hops: what can be reached from the seeds (id) in at most `depth` undirected steps, seeds at 0."""
    both = edges.select(F.col("source_id").alias("id"), F.col("target_id").alias("to")).unionByName(edges.select(F.col("target_id").alias("id"), F.col("source_id").alias("to"))).distinct()
    seen = seeds.select("id").distinct().withColumn("hops", F.lit(0))
    front = seen
    for hop in range(1, depth + 1):
        front = front.select("id").join(both, "id").select(F.col("to").alias("id")).distinct().join(seen, "id", "left_anti").withColumn("hops", F.lit(hop))
        seen = materialize(seen.unionByName(front), "layer")
        front = seen.where(F.col("hops") == hop)
    return seen


def connected(vertices: DataFrame, both: DataFrame) -> bool:
    """Whether the vertices (a, distinct) are one component under edges given in both directions (a, b).

    Each round every vertex goes to the one of its neighbours and itself that comes first in a random order; what is
    left is a smaller graph with as many components. It takes about the logarithm of the vertices in rounds, and ends as
    soon as a component has shrunk to a point."""
    left, rounds = vertices.count(), 0
    while left > 1:
        touched = both.select("a").distinct().count()
        if touched < left:
            return False
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(rounds)).alias("h"), F.col(c).alias("v"))
        to = both.groupBy("a").agg(F.least(F.min(rank("b")), F.min(rank("a"))).alias("m")).select("a", F.col("m.v").alias("to"))
        to = materialize(to, "contracted")
        left = to.select("to").distinct().count()
        ends = both.join(to, "a").select(F.col("to").alias("x"), F.col("b").alias("a")).join(to, "a").select(F.col("x").alias("a"), F.col("to").alias("b"))
        both = materialize(ends.where("a <> b").distinct(), "links")
        rounds += 1
    return True


def fiedler(edges: DataFrame, steps: int = 1000, vertices: DataFrame | None = None, tolerance: float = 1e-4) -> float:
    """The algebraic connectivity (second smallest eigenvalue of the weighted Laplacian) of the undirected graph of all
    vertices (id; the ends of edges if not given); edges to other ids are left out. Of several edges of a pair that with
    the greatest id counts, if its weight is positive. 0 for fewer than three vertices and for more than one component.

    Else locally optimal conjugate gradients, preconditioned by the degrees: one join and one aggregation a step over
    the distributed vectors, which are written each step. They end when the residual's norm is at most `tolerance` times
    the Rayleigh quotient, which is then an eigenvalue to that relative error, mostly its square. A run that has not got
    there in `steps` steps is an error, not a result."""
    pair = edges.where("source_id <> target_id").select(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b"), "id", "weight")
    pair = pair.groupBy("a", "b").agg(F.max_by("weight", "id").alias("w")).where("w > 0")
    if vertices is not None:
        vertices = materialize(vertices.select(F.col("id").alias("a")).distinct(), "vertices")
        for end in ("a", "b"):
            pair = pair.join(vertices.withColumnRenamed("a", end), end, "left_semi")
    pair = materialize(pair.select("a", "b", "w"), "pairs")
    both = materialize(pair.unionByName(pair.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")), "adjacency")
    degree = materialize(both.groupBy("a").agg(F.sum("w").alias("d")), "degree")
    points = degree.select("a") if vertices is None else vertices
    n = points.count()
    if n < 3 or not connected(points, both.select("a", "b")):
        return 0.0

    names = ("x", "w", "p")
    sums = {f"{u}_{v}": F.sum(F.col(u) * F.col(v)) for i, u in enumerate(names) for v in names[i:]}
    sums |= {f"{u}_l{v}": F.sum(F.col(u) * F.col(f"l{v}")) for i, u in enumerate(names) for v in names[i:]}

    def times(y: DataFrame, column: str) -> DataFrame:
        """y with l<column>, the Laplacian's product with the column."""
        pulled = both.select("a", "b", F.col("w").alias("_w")).join(y.select(F.col("a").alias("b"), F.col(column).alias("_v")), "b").groupBy("a").agg(F.sum(F.col("_w") * F.col("_v")).alias("_s"))
        return y.join(pulled, "a").withColumn(f"l{column}", F.col("d") * F.col(column) - F.col("_s")).drop("_s")

    start = degree.withColumn("x", F.pmod(F.xxhash64("a"), F.lit(2000)) / 1000.0 - 1)
    start = times(materialize(start.withColumn("x", F.col("x") - F.lit(start.agg(F.avg("x")).first()[0])), "start"), "x")
    y = materialize(start.withColumns({"p": F.lit(0.0), "lp": F.lit(0.0)}), "start")
    s = y.agg(F.sum(F.col("x") * F.col("lx")).alias("l"), F.sum(F.col("x") * F.col("x")).alias("n")).first()
    value = s.l / s.n
    for _ in range(steps):
        residual = materialize(y.withColumn("r", F.col("lx") - value * F.col("x")).withColumn("w", F.col("r") / F.col("d")), "residual")
        s = residual.agg(F.sum(F.col("r") * F.col("r")).alias("r"), F.sum(F.col("x") * F.col("x")).alias("n"), F.avg("w").alias("m")).first()
        if s.r**0.5 <= tolerance * value * s.n**0.5:
            return value
        y = materialize(times(residual.withColumn("w", F.col("w") - s.m).drop("r"), "w"), "step")
        g = y.agg(*[c.alias(k) for k, c in sums.items()]).first()
        gram, form = (np.array([[g[f"{u}_{of}{v}"] if f"{u}_{of}{v}" in sums else g[f"{v}_{of}{u}"] for v in names] for u in names]) for of in ("", "l"))
        size = np.sqrt(np.maximum(gram.diagonal(), 0))
        scale = np.divide(1, size, out=np.zeros(3), where=size > 0)
        length, turn = np.linalg.eigh(gram * np.outer(scale, scale))
        keep = length > 1e-12
        basis = (scale[:, None] * turn[:, keep]) / np.sqrt(length[keep])
        values, best = np.linalg.eigh(basis.T @ form @ basis)
        value, c = float(values[0]), [float(z) for z in basis @ best[:, 0]]
        mix = lambda l: {f"{l}x": c[0] * F.col(f"{l}x") + c[1] * F.col(f"{l}w") + c[2] * F.col(f"{l}p"), f"{l}p": c[1] * F.col(f"{l}w") + c[2] * F.col(f"{l}p")}  # noqa: E731,E741
        y = y.withColumns(mix("") | mix("l")).drop("w", "lw")
    raise ArithmeticError(f"the algebraic connectivity has not converged in {steps} steps")
