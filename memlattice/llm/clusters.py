"""Grouping vectors into similarity clusters with a Gaussian mixture.

The vectors are standardised and reduced to their principal components; a mixture of Gaussians with regularised full
covariances is fitted to all of them by expectation-maximisation, each step one Spark job that adds up sufficient
statistics; of several numbers of components the Bayesian information criterion takes one. A vector belongs to the
most probable component, and is compared, within its own group (a namespace), with the vectors of all components that
are probable for it: those whose cosine reaches the group's threshold come together under the smallest id, over as many
steps as it takes. An exact check against all members of such a group keeps those that are similar to each of them; the
others are grouped again among themselves, until none is left. Members with the highest density under the mixture stand
for a cluster.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memlattice.operators.blocks import blockwise
from memlattice.tables import materialize
from memlattice.vectors import lists, matrix, unit

REDUCED, STEPS, RIDGE, ROWS_A_COMPONENT = 20, 8, 0.05, 400
#: After so many steps only the number of components with the best criterion is fitted on.
TRIAL_STEPS = 3
#: A model whose likelihood rises by less than this share in a step has settled.
SETTLED = 1e-4
#: Initial means are drawn from at most about this many rows (or four a component, if that is more); everything else is
#: fitted on all rows.
SEED_ROWS = 8192
#: A vector is compared with at most this many components, those whose log probability is within WITHIN of the best.
PROBES, WITHIN, BLOCK_ROWS = 12, 16.0, 2048


def most_components(n: int) -> int:
    """ROWS_A_COMPONENT rows each for small collections; for large ones twice the root of their number, so that neither
    the fit nor the comparison within components grows with the square."""
    return max(1, min(n // ROWS_A_COMPONENT, math.ceil(2 * math.sqrt(n))))


def added(partials: DataFrame, lengths: dict[int, int]) -> dict[int, np.ndarray]:
    """Element-wise sums of packed float64 arrays by `name`. Tasks' sums are added up within 16 salts by one aggregation;
    16 arrays a name reach the driver, whatever the number of tasks."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(lengths[pdf.name.iloc[0]])
        for x in pdf.data:
            total += np.frombuffer(x)
        return pd.DataFrame({"name": pdf.name.iloc[:1], "data": [total.tobytes()]})

    part = partials.select("name", F.pmod(F.spark_partition_id(), F.lit(16)).alias("salt"), "data")
    sums = {name: np.zeros(n) for name, n in lengths.items()}
    for r in part.groupBy("name", "salt").applyInPandas(add, "name int, data binary").collect():
        sums[r.name] += np.frombuffer(r.data)
    return sums


class Reduction:
    """Standardises unit vectors and projects them to their principal components with unit variance."""

    def __init__(self, n: float, total: np.ndarray, outer: np.ndarray, reduced: int):
        self.mean = total / n
        cov = outer / n - np.outer(self.mean, self.mean)
        self.deviation = np.sqrt(np.maximum(np.diag(cov), 1e-12))
        value, axis = np.linalg.eigh(cov / np.outer(self.deviation, self.deviation))
        keep = np.argsort(-value, kind="stable")[:reduced]
        self.axes = axis[:, keep] / np.sqrt(np.maximum(value[keep], 1e-9))

    def __call__(self, m: np.ndarray) -> np.ndarray:
        return ((m - self.mean) / self.deviation) @ self.axes


def fit_reduction(vectors: DataFrame, dim: int, reduced: int) -> Reduction:
    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + dim + dim * dim)
        for b in batches:
            m = np.frombuffer(b"".join(b.column(0).to_pylist()), np.float32).reshape(-1, dim).astype(np.float64)
            total += np.concatenate([[len(m)], m.sum(axis=0), (m.T @ m).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["name", "data"])

    partial = vectors.select("unit").mapInArrow(moments, "name int, data binary")
    total = added(partial, {0: 1 + dim + dim * dim})[0]
    return Reduction(total[0], total[1 : dim + 1], total[dim + 1 :].reshape(dim, dim), reduced)


class Mixture:
    """Weights, means and covariances of Gaussian components."""

    def __init__(self, weight: np.ndarray, mean: np.ndarray, cov: np.ndarray):
        self.weight, self.mean = weight, mean
        root = np.linalg.cholesky(cov)
        self.whiten = np.linalg.inv(root).transpose(0, 2, 1)
        d = mean.shape[1]
        self.constant = np.log(np.maximum(weight, 1e-300)) - 0.5 * d * np.log(2 * np.pi) - np.log(np.diagonal(root, axis1=1, axis2=2)).sum(axis=1)

    @classmethod
    def start(cls, seeds: np.ndarray, k: int) -> Mixture:
        """Components of unit variance at seeds that are far from each other."""
        draw, chosen = np.random.default_rng(11), [0]
        far = ((seeds - seeds[0]) ** 2).sum(axis=1)
        for _ in range(k - 1):
            chosen.append(int(draw.choice(len(seeds), p=far / far.sum())) if far.sum() > 0 else 0)
            far = np.minimum(far, ((seeds - seeds[chosen[-1]]) ** 2).sum(axis=1))
        return cls(np.full(k, 1 / k), seeds[chosen], np.repeat(np.eye(seeds.shape[1])[None], k, axis=0))

    @classmethod
    def of(cls, stats: np.ndarray, k: int, d: int, ridge: float) -> Mixture:
        """From sufficient statistics; a component without rows gets the common covariance."""
        s = stats.reshape(k, 1 + d + d * d)
        n = s[:, 0] + 1e-9
        mean = s[:, 1 : d + 1] / n[:, None]
        second = s[:, d + 1 :].reshape(k, d, d)
        prior = d + 2.0  # a prior of as many rows, of unit covariance, keeps small components regular
        scatter = second - n[:, None, None] * mean[:, :, None] * mean[:, None, :]
        cov = (scatter + prior * 0.5 * np.eye(d)) / (n + prior)[:, None, None] + ridge * np.eye(d)
        return cls(n / n.sum(), mean, cov)

    def log_joint(self, x: np.ndarray) -> np.ndarray:
        """Log of weight times density of each component (columns) at each row."""
        k, d = self.mean.shape
        shifted = np.einsum("kd,kde->ke", self.mean, self.whiten)
        z = (x @ self.whiten.transpose(1, 0, 2).reshape(d, k * d)).reshape(-1, k, d) - shifted
        return self.constant - 0.5 * (z * z).sum(axis=2)

    def statistics(self, x: np.ndarray) -> tuple[np.ndarray, float]:
        joint = self.log_joint(x)
        top = joint.max(axis=1, keepdims=True)
        share = np.exp(joint - top)
        total = share.sum(axis=1, keepdims=True)
        share /= total
        pairs = (x[:, :, None] * x[:, None, :]).reshape(len(x), -1)
        return share.T @ np.hstack([np.ones((len(x), 1)), x, pairs]), float((top + np.log(total)).sum())


def criterion(log_likelihood: float, k: int, d: int, n: int) -> float:
    """The Bayesian information criterion; lower is better."""
    return -2 * log_likelihood + (k * (1 + d + d * (d + 1) / 2) - 1) * np.log(n)


def fit_mixture(features: DataFrame, n: int, d: int, components: list[int], steps: int = STEPS, ridge: float = RIDGE) -> tuple[Mixture, dict[int, float]]:
    """The mixture with the lowest criterion over the given numbers of components, and each number's criterion, as far as
    it was fitted: after TRIAL_STEPS steps only the best goes on, until its likelihood settles or after `steps` steps.

    features: x (array of d numbers). What goes to the driver and to the executors is the components' parameters and
    sums of statistics, whatever the number of rows.
    """
    sample = max(SEED_ROWS, 4 * max(components))
    seeds = features.where(F.pmod(F.xxhash64("x"), F.lit(10**15)) < math.ceil(min(1.0, sample / n) * 10**15)).select("x").toArrow()
    seeds = matrix(seeds.column(0).combine_chunks(), d).astype(np.float64)
    seeds = seeds[np.lexsort(seeds.T)]
    fitted = {k: Mixture.start(seeds, k) for k in components}
    width = 1 + d + d * d
    scores: dict[int, float] = {}
    for step in range(steps):
        sent = features.sparkSession.sparkContext.broadcast(fitted)

        def gather(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            sums = {k: np.zeros(k * width + 1) for k in sent.value}
            for b in batches:
                x = matrix(b.column(0), d).astype(np.float64)
                for lo in range(0, len(x), 1024):
                    for k, mixture in sent.value.items():
                        stats, likelihood = mixture.statistics(x[lo : lo + 1024])
                        sums[k][:-1] += stats.ravel()
                        sums[k][-1] += likelihood
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["name", "data"])

        partial = features.select("x").mapInArrow(gather, "name int, data binary")
        before = dict(scores)
        for k, s in added(partial, {k: k * width + 1 for k in fitted}).items():
            scores[k] = criterion(s[-1], k, d, n)
            fitted[k] = Mixture.of(s[:-1], k, d, ridge)
        sent.unpersist()
        if step + 1 >= TRIAL_STEPS:
            best = min(fitted, key=lambda k: (scores[k], k))
            fitted = {best: fitted[best]}
            if abs(before.get(best, math.inf) - scores[best]) <= SETTLED * abs(scores[best]):
                break
    best = min(fitted, key=lambda k: (scores[k], k))
    return fitted[best], scores


def smallest_reached(edges: DataFrame) -> DataFrame:
    """rep, lead: the smallest rep that each can reach over the edges (rep, lead <= rep), one or several a rep; steps go
    on until none changes a lead."""
    leads = materialize(edges.groupBy("rep").agg(F.min("lead").alias("lead")), "leads")
    while True:
        further = leads.select(F.col("rep").alias("lead"), F.col("lead").alias("further")).where("further <> lead")
        pulled = leads.join(further, "lead").select("rep", F.col("further").alias("lead"))  # the lead's lead
        pushed = edges.join(leads.withColumnRenamed("lead", "mine"), "rep").select(F.col("lead").alias("rep"), F.col("mine").alias("lead"))  # the lead's other edges
        both = leads.unionByName(pulled).unionByName(pushed).groupBy("rep").agg(F.min("lead").alias("lead"))
        both = materialize(both, "leads")
        if both.join(leads, ["rep", "lead"], "left_anti").isEmpty():
            return both
        leads = both


def clusters(df: DataFrame, dim: int, thresholds: DataFrame, default_threshold: float = 0.7, reduced: int = REDUCED, components: int | None = None) -> DataFrame:
    """id, namespace, cluster_id, density: the members of clusters of two or more.

    df: id (unique, not null), namespace, embedding (dim numbers, not all zero). thresholds: namespace, threshold; a
    namespace that has none, or null, has default_threshold. Rows without a namespace are one group. cluster_id is the
    smallest id of the cluster. Exact copies are compared once. Where similarity is not transitive, what is linked is a
    group, its members that are similar to all of it are a cluster, and the others are grouped again: each under the
    smallest id that it is similar to. components: the greatest number tried, most_components(n) if not given.
    """
    spark = df.sparkSession
    rows = df.select("id", F.coalesce("namespace", F.lit("")).alias("ns"), "embedding", F.xxhash64("embedding").alias("vec"))
    rows = materialize(rows, "rows")

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = unit(matrix(b.column(2), dim)) if b.num_rows else []
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([v.tobytes() for v in m], pa.binary())], names=["rep", "ns", "unit"])

    kinds = rows.groupBy("ns", "vec").agg(F.min("id").alias("rep"), F.any_value("embedding").alias("embedding"))
    vectors = materialize(kinds.select("rep", "ns", "embedding").mapInArrow(units, "rep string, ns string, unit binary"), "units")
    n = vectors.count()
    if n == 0:
        return spark.createDataFrame([], "id string, namespace string, cluster_id string, density double")
    d = min(reduced, dim)
    reduction = spark.sparkContext.broadcast(fit_reduction(vectors, dim, d))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = reduction.value(np.frombuffer(b"".join(b.column(2).to_pylist()), np.float32).reshape(-1, dim))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), lists(x.astype(np.float32))], names=["rep", "ns", "unit", "x"])

    placed = materialize(vectors.mapInArrow(features, "rep string, ns string, unit binary, x array<float>"), "features")
    most = components or most_components(n)
    mixture, _ = fit_mixture(placed, n, d, sorted({most, max(1, most // 2), max(1, most // 4)}))
    sent = spark.sparkContext.broadcast(mixture)

    def belong(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(1), d).astype(np.float64)
            comps, density = [], []
            for lo in range(0, len(x), 1024):
                joint = sent.value.log_joint(x[lo : lo + 1024])
                top = np.argsort(-joint, axis=1, kind="stable")[:, :PROBES]
                value = np.take_along_axis(joint, top, 1)
                comps += [t[v >= v[0] - WITHIN].tolist() for t, v in zip(top, value, strict=True)]
                density.append(value[:, 0] + np.log(np.exp(joint - value[:, :1]).sum(axis=1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(comps, pa.list_(pa.int32())), pa.array(np.concatenate(density) if density else [], pa.float64())], names=["rep", "components", "density"])

    assigned = materialize(placed.select("rep", "x").mapInArrow(belong, "rep string, components array<int>, density double"), "components")
    at = thresholds.groupBy(F.coalesce("namespace", F.lit("")).alias("ns")).agg(F.min("threshold").alias("threshold"))
    known = placed.select("rep", "ns", "unit").join(F.broadcast(at), "ns", "left").withColumn("threshold", F.coalesce("threshold", F.lit(default_threshold)).cast("double"))
    held = known.join(assigned.select("rep", F.col("components")[0].alias("component")), "rep")
    asked = known.join(assigned.select("rep", F.explode("components").alias("component")), "rep")

    def units_of(s: pd.DataFrame) -> np.ndarray:
        return np.frombuffer(b"".join(s.unit), np.float32).reshape(-1, dim).astype(np.float64)

    def lead(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        """The smallest similar row of each row on both sides; similarity goes both ways, probing does not."""
        if not len(a) or not len(b):
            return pd.DataFrame({"rep": [], "lead": []})
        a, b = a.sort_values("rep", kind="stable"), b.sort_values("rep", kind="stable")
        like = units_of(a) @ units_of(b).T >= a.threshold.to_numpy()[:, None] - 1e-7
        mine, theirs = a.rep.to_numpy(dtype=object), b.rep.to_numpy(dtype=object)
        one = pd.DataFrame({"rep": mine, "lead": theirs[like.argmax(axis=1)]})[like.any(axis=1)]
        two = pd.DataFrame({"rep": theirs, "lead": mine[like.argmax(axis=0)]})[like.any(axis=0)]
        both = pd.concat([one, two])
        return both[both["lead"] < both.rep]

    found = materialize(blockwise(asked, held, ["component", "ns"], "rep", lead, "rep string, lead string", BLOCK_ROWS).distinct(), "found")
    leads = smallest_reached(found.unionByName(known.select("rep", F.col("rep").alias("lead"))))

    def alike(a: pd.DataFrame, b: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each lead that both blocks have: its rows of either (by position) and which of them are similar."""
        if not len(a) or not len(b):
            return
        code, _ = pd.factorize(pd.concat([a["lead"], b["lead"]]))
        one, two = code[: len(a)], code[len(a) :]
        at, to = np.argsort(one, kind="stable"), np.argsort(two, kind="stable")
        x, y, limit = units_of(a), units_of(b), a.threshold.to_numpy() - 1e-7
        theirs, _ = pd.factorize(pd.concat([a.rep, b.rep]))
        both = np.intersect1d(one, two)
        bounds = [np.searchsorted(c[o], both, side) for c, o in ((one, at), (two, to)) for side in ("left", "right")]
        for lo, hi, low, high in zip(*bounds, strict=True):
            mine, other = at[lo:hi], to[low:high]
            like = x[mine] @ y[other].T >= limit[mine, None]
            yield mine, other, like | (theirs[mine, None] == theirs[len(a) + other])

    def agree(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(len(a), np.int64)
        for mine, _, like in alike(a, b):
            total[mine] = like.sum(axis=1)
        return pd.DataFrame({"lead": a["lead"], "rep": a.rep, "n": a.n, "like": total})

    def again(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("rep", kind="stable")
        names, best = b.rep.to_numpy(dtype=object), np.full(len(a), -1)
        for mine, other, like in alike(a, b):
            best[mine] = np.where(like.any(axis=1), other[like.argmax(axis=1)], -1)
        return pd.DataFrame({"rep": a.rep.to_numpy()[best >= 0], "lead": names[best[best >= 0]]})

    def grouped(leads: DataFrame) -> DataFrame:
        """known with lead, the lead's number of rows (two or more), and a bucket of some leads."""
        sizes = leads.groupBy("lead").agg(F.count("*").alias("n")).where("n > 1")
        return known.join(leads.join(sizes, "lead"), "rep").withColumn("bucket", F.pmod(F.xxhash64("lead"), F.lit(max(1, n // 1024))))

    def checked(leads: DataFrame) -> DataFrame:
        """lead, rep of leads with several rows, and whether the row is similar to all of them."""
        several = grouped(leads)
        agreed = blockwise(several, several, ["bucket"], "rep", agree, "lead string, rep string, n bigint, like bigint", BLOCK_ROWS)
        agreed = agreed.groupBy("lead", "rep").agg(F.max("n").alias("n"), F.sum("like").alias("like"))
        return materialize(agreed.select("lead", "rep", (F.col("like") >= F.col("n")).alias("all")), "agreed")

    def named(agreed: DataFrame) -> DataFrame:
        """The rows that are similar to all of their lead's, under the smallest of them."""
        kept = agreed.where("all")
        return kept.join(kept.groupBy("lead").agg(F.min("rep").alias("name")), "lead").select("rep", F.col("name").alias("lead"))

    agreed = checked(leads)
    parts = [named(agreed)]
    pending = agreed.where(~F.col("all")).select("rep", "lead")
    while not pending.isEmpty():  # the smallest id of what is left of a group is done with each round
        several = grouped(pending)
        leads = blockwise(several, several, ["bucket"], "rep", again, "rep string, lead string", BLOCK_ROWS).groupBy("rep").agg(F.min("lead").alias("lead"))
        leads = materialize(leads, "led")
        agreed = checked(leads)
        parts.append(named(agreed))
        single = leads.groupBy("lead").agg(F.count("*").alias("n"), F.max("rep").alias("rep")).where("n = 1 and rep = lead").select("rep")
        done = agreed.where("all").select("rep").unionByName(single)
        pending = materialize(several.select("rep", "lead").join(done, "rep", "left_anti"), "pending")
    led = parts[0]
    for p in parts[1:]:
        led = led.unionByName(p)
    alone = known.select("rep").join(led.select("rep"), "rep", "left_anti").select("rep", F.col("rep").alias("lead"))  # its copies may be a cluster
    led = materialize(led.unionByName(alone), "clusters")

    copies = rows.groupBy("ns", "vec").agg(F.min("id").alias("rep"), F.count("*").alias("n_copies"))
    counts = led.join(copies.select("rep", "n_copies"), "rep").groupBy("lead").agg(F.sum("n_copies").alias("size"), F.min("rep").alias("cluster_id")).where("size > 1")
    members = led.join(counts, "lead").join(assigned.select("rep", "density"), "rep").join(copies.select("rep", "ns", "vec"), "rep")
    return members.join(rows.select("id", "ns", "vec"), ["ns", "vec"]).select("id", F.nullif("ns", F.lit("")).alias("namespace"), "cluster_id", "density")


def described(members: DataFrame, typical: int = 3) -> DataFrame:
    """One row a cluster: size and its `typical` members with the highest density (then the smallest id), best first."""
    order = Window.partitionBy("cluster_id").orderBy(F.desc("density"), "id")
    best = members.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= typical)
    best = best.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("nth", "id"))).alias("t"))  # `typical` at most
    sizes = members.groupBy("cluster_id").agg(F.max("namespace").alias("namespace"), F.count("*").alias("n_members"), F.max("density").alias("density"))
    return sizes.join(best, "cluster_id").select("cluster_id", "namespace", "n_members", F.array_join(F.transform("t", lambda x: x["id"]), " ").alias("typical"))
