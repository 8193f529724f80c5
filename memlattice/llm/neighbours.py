"""The most similar vectors for every vector: learned partitions with classifier routing, then exact reranking.

A bounded sample is linked to its nearest neighbours; that graph is cut into parts of balanced size with few links
between them; a small softmax classifier learns each vector's part, with its neighbours' parts as soft labels. Every
vector of the collection, not only the sample, is indexed in its most probable part, and as a query is routed to those
that together have most of the probability, where the cosines are exact. Parts that hold many vectors are searched in blocks.

Exact copies of a vector are indexed once; their smallest k + 1 ids stand for them, which is enough for any k nearest
(ties go to the smaller id), however many copies there are.
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
from memlattice.vectors import matrix, unit

#: The classifier and its graph are fitted on about this many vectors, or 32 a part if that is more, chosen by their hash.
SAMPLE_ROWS = 8192
#: Parts grow with the root of the number of vectors, up to what one machine can fit: some nine million vectors reach it.
#: Beyond that parts become larger and are searched in more blocks; nothing is left out.
MOST_PARTS, LINKS, BLOCK_ROWS = 1024, 10, 4096
#: A query is routed to parts until their probabilities sum up to MASS, or there are `probes`.
MASS, SHARPNESS = 0.8, 8


def neighbour_graph(m: np.ndarray, links: int) -> np.ndarray:
    """Of each unit vector the rows of its nearest others, by blocks of rows."""
    links = min(links, len(m) - 1)
    out = np.empty((len(m), links), np.int64)
    for lo in range(0, len(m), 512):
        cos = m[lo : lo + 512] @ m.T
        cos[np.arange(len(cos)), np.arange(lo, lo + len(cos))] = -2
        out[lo : lo + 512] = np.argpartition(-cos, links - 1, axis=1)[:, :links] if links < len(m) - 1 else np.argsort(-cos, axis=1)[:, :links]
    return out


def balanced_parts(m: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12, slack: float = 1.1) -> np.ndarray:
    """The part of each vector: halving along the widest direction gives equal parts; then vectors move to the part
    where most of their neighbours are, best gains first, while it has room."""
    label = np.zeros(len(m), np.int64)
    groups = [(np.arange(len(m)), 0, parts)]
    while groups:
        rows, first, n = groups.pop()
        if n == 1 or len(rows) < 2:
            label[rows] = first
            continue
        centred = m[rows] - m[rows].mean(axis=0)
        axis = centred[np.argmax((centred**2).sum(axis=1))]
        for _ in range(8):
            axis = centred.T @ (centred @ axis)
            axis /= np.linalg.norm(axis) + 1e-12
        order = np.argsort(centred @ axis, kind="stable")
        cut = len(rows) * (n // 2) // n
        groups += [(rows[order[:cut]], first, n // 2), (rows[order[cut:]], first + n // 2, n - n // 2)]
    room = math.ceil(slack * len(m) / parts)
    both = np.concatenate([np.repeat(np.arange(len(m)), graph.shape[1]), graph.ravel()]), np.concatenate([graph.ravel(), np.repeat(np.arange(len(m)), graph.shape[1])])
    for _ in range(rounds):
        votes = np.bincount(both[0] * parts + label[both[1]], minlength=len(m) * parts).reshape(len(m), parts)
        best = votes.argmax(axis=1)
        gain = votes[np.arange(len(m)), best] - votes[np.arange(len(m)), label]
        sizes, moved = np.bincount(label, minlength=parts), 0
        for i in np.argsort(-gain, kind="stable")[: int((gain > 0).sum())]:
            if sizes[best[i]] < room:
                sizes[label[i]] -= 1
                label[i] = best[i]
                sizes[best[i]] += 1
                moved += 1
        if not moved:
            break
    return label


def fit_router(m: np.ndarray, soft: np.ndarray, epochs: int = 40, rate: float = 0.02) -> np.ndarray:
    """Weights (dim + 1, parts) of a softmax classifier, by Adam on batches in a fixed random order."""
    x = np.hstack([m, np.ones((len(m), 1), np.float32)])
    w = np.zeros((x.shape[1], soft.shape[1]), np.float32)
    first, second, t, draw = np.zeros_like(w), np.zeros_like(w), 0, np.random.default_rng(7)
    for _ in range(epochs):
        order = draw.permutation(len(x))
        for lo in range(0, len(x), 512):
            rows = order[lo : lo + 512]
            z = x[rows] @ w * SHARPNESS
            z = np.exp(z - z.max(axis=1, keepdims=True))
            grad = x[rows].T @ (z / z.sum(axis=1, keepdims=True) - soft[rows]) / len(rows)
            t += 1
            first += (grad - first) * 0.1
            second += (grad**2 - second) * 0.01
            w -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-7)
    return w


def learn_router(m: np.ndarray, parts: int) -> np.ndarray:
    if parts == 1 or len(m) < 2 * parts:
        return np.zeros((m.shape[1] + 1, 1), np.float32)
    graph = neighbour_graph(m, LINKS)
    label = balanced_parts(m, graph, parts)
    soft = np.zeros((len(m), parts), np.float32)
    np.add.at(soft, (np.arange(len(m)), label), 0.5)
    np.add.at(soft, (np.repeat(np.arange(len(m)), graph.shape[1]), label[graph].ravel()), 0.5 / graph.shape[1])
    return fit_router(m, soft)


def route(m: np.ndarray, w: np.ndarray, probes: int, mass: float = MASS) -> list[np.ndarray]:
    """The most probable parts of each vector, best first: as many as together have the given probability, at most
    `probes`."""
    z = np.hstack([m, np.ones((len(m), 1), np.float32)]) @ w * SHARPNESS
    p = np.exp(z - z.max(axis=1, keepdims=True))
    order = np.argsort(-p, axis=1, kind="stable")[:, :probes].astype(np.int32)
    total = np.cumsum(np.take_along_axis(p, order, 1) / p.sum(axis=1, keepdims=True), axis=1)
    return [o[: 1 + int((t < mass).sum())] for o, t in zip(order, total, strict=True)]


def nearest(df: DataFrame, dim: int, k: int = 5, probes: int = 16, least: float = -1.0, sample_rows: int = SAMPLE_ROWS, most_parts: int = MOST_PARTS) -> DataFrame:
    """id, neighbour, score (cosine), rank from 1: the k most similar other ids of each id, of those with a cosine of
    `least` or more. df: id (unique, not null), embedding (dim numbers, not all zero). Equal scores go to the smaller id.
    """
    spark = df.sparkSession
    copies = materialize(df.select("id", "embedding", F.xxhash64("embedding").alias("vec")), "vectors")
    heads = copies.select("vec", "id").withColumn("n", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).where(F.col("n") <= k + 1)
    heads = heads.groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids"))  # k + 1 at most
    distinct = copies.groupBy("vec").agg(F.min_by("embedding", "id").alias("embedding"))
    distinct = materialize(distinct, "distinct")
    n = distinct.count()
    if n == 0:
        return spark.createDataFrame([], "id string, neighbour string, score double, rank int")
    parts = max(1, min(most_parts, round(math.sqrt(n) / 3)))
    sampled = distinct.where(F.pmod(F.xxhash64("vec"), F.lit(10**15)) < math.ceil(min(1.0, max(sample_rows, 32 * parts) / n) * 10**15)).select("embedding").toArrow()
    w = learn_router(unit(matrix(sampled.column(0).combine_chunks(), dim)), parts)
    sent = spark.sparkContext.broadcast(w)  # (dim + 1) x parts numbers, whatever the number of vectors

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                m = unit(matrix(b.column(1), dim))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(route(m, sent.value, probes), pa.list_(pa.int32())), pa.array([v.tobytes() for v in m], pa.binary())], names=["vec", "parts", "unit"])

    index = materialize(distinct.select("vec", "embedding").mapInArrow(routed, "vec bigint, parts array<int>, unit binary"), "index")
    held = index.select("vec", F.col("parts")[0].alias("part"), "unit")
    asked = index.select("vec", F.explode("parts").alias("part"), "unit")

    def search(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(held):
            base = np.frombuffer(b"".join(held.unit), np.float32).reshape(len(held), dim)
            mine, theirs = asked.vec.to_numpy(), held.vec.to_numpy()
            for lo in range(0, len(asked), 1024):
                cos = np.frombuffer(b"".join(asked.unit[lo : lo + 1024]), np.float32).reshape(-1, dim) @ base.T
                cos[mine[lo : lo + 1024, None] == theirs] = -3
                top = np.argpartition(-cos, min(k, len(held)) - 1, axis=1)[:, :k] if len(held) > k else np.tile(np.arange(len(held)), (len(cos), 1))
                score = np.take_along_axis(cos, top, 1)
                row, at = np.nonzero(score >= least - 1e-6)
                out.append(pd.DataFrame({"vec": mine[lo + row], "near": theirs[top[row, at]], "score": score[row, at].astype(np.float64)}))
        found = pd.concat(out) if out else pd.DataFrame({"vec": [], "near": [], "score": []})
        return found[found.score > -2].astype({"vec": "int64", "near": "int64"})

    found = blockwise(asked, held, ["part"], "vec", search, "vec bigint, near bigint, score double", BLOCK_ROWS)
    found = found.withColumn("n", F.row_number().over(Window.partitionBy("vec").orderBy(F.desc("score"), "near"))).where(F.col("n") <= k).drop("n")
    found = found.unionByName(distinct.select("vec", F.col("vec").alias("near"), F.lit(1.0).alias("score")))  # its own copies
    near = found.join(heads.withColumnRenamed("vec", "near"), "near").select("vec", "score", F.explode("ids").alias("neighbour"))
    near = near.withColumn("n", F.row_number().over(Window.partitionBy("vec").orderBy(F.desc("score"), "neighbour"))).where(F.col("n") <= k + 1).drop("n")
    answers = near.groupBy("vec").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "neighbour"))).alias("near"))  # k + 1 at most
    per_id = copies.select("vec", "id").join(answers, "vec").select("id", F.slice(F.filter("near", lambda x: x["neighbour"] != F.col("id")), 1, k).alias("near"))
    return per_id.select("id", F.posexplode("near").alias("at", "x")).select("id", F.col("x.neighbour").alias("neighbour"), (-F.col("x.far")).alias("score"), (F.col("at") + 1).alias("rank")).where(F.col("score") >= least)


def similar_pairs(near: DataFrame) -> DataFrame:
    """Unordered pairs id_a < id_b of which one is among the other's nearest."""
    return near.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
