"""Retrieval over memories: exact nearest neighbours, text search, spreading activation, rank fusion, gating."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memlattice.functions.scoring import clamp, cosine
from memlattice.functions.text import tokenize
from memlattice.operators.blocks import blockwise
from memlattice.vectors import usable


def top_k(df: DataFrame, k: int, by: list[str], *order: Column | str) -> DataFrame:
    """The first k rows of each group; Spark limits each task's groups before the shuffle."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= k).drop("_n")


def nearest(rows: DataFrame, vector: list[float] | DataFrame, k: int) -> DataFrame:
    """rows with score (cosine) and distance (1 - score): the k most similar to one vector, given as a list or as a
    DataFrame of one row with `query`. Rows without a usable embedding of that length, and faded ones, are left out;
    equal scores go to the smaller id."""
    if isinstance(vector, list):
        scored = rows.withColumn("query", F.lit(vector))
    else:
        scored = rows.crossJoin(F.broadcast(vector.select("query").limit(1)))  # one row
    scored = scored.where(F.size("embedding") == F.size("query")).withColumn("score", cosine("embedding", "query")).drop("query")
    if "faded" in rows.columns:
        scored = scored.where(~F.coalesce("faded", F.lit(False)))
    return scored.where("score is not null").withColumn("distance", 1 - F.col("score")).orderBy(F.desc("score"), "id").limit(k)


def nearest_batch(queries: DataFrame, rows: DataFrame, dim: int, k: int, least: float = -1.0, block_rows: int = 4096) -> DataFrame:
    """query_id, id, score: for each query row (query_id, embedding) the k most similar rows (id, embedding), exactly.

    The query set is met with all rows in blocks. Vectors that are no usable ones of `dim` numbers are left out; a
    query does not find its own id. Of equal scores (to 9 places) the smaller id comes first.
    """
    q = queries.where(usable("embedding", dim)).select(F.lit(0).alias("all"), F.col("query_id").alias("id"), "embedding")
    r = rows.where(usable("embedding", dim)).select(F.lit(0).alias("all"), "id", "embedding")

    def search(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(held):
            held = held.sort_values("id", kind="stable")
            unit = lambda s: (m := np.stack(s.to_numpy()).astype(np.float64)) / np.linalg.norm(m, axis=1, keepdims=True)
            ids, base = held.id.to_numpy(), unit(held.embedding)
            for lo in range(0, len(asked), 512):
                part = asked.iloc[lo : lo + 512]
                cos = unit(part.embedding) @ base.T
                cos[part.id.to_numpy()[:, None] == ids] = -3
                order = np.argsort(-cos.round(9), axis=1, kind="stable")[:, :k]
                score = np.take_along_axis(cos, order, 1)
                at, nth = np.nonzero((score >= least) & (score > -2))
                out.append(pd.DataFrame({"query_id": part.id.to_numpy()[at], "id": ids[order[at, nth]], "score": score[at, nth]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "id": [], "score": []})

    found = blockwise(q, r, ["all"], "id", search, "query_id string, id string, score double", block_rows)
    return top_k(found, k, ["query_id"], F.desc(F.round("score", 9)), "id")


def similarity_links(queries: DataFrame, rows: DataFrame, dim: int, block_rows: int = 4096) -> DataFrame:
    """query_id, id, score, n_links: for each usable query row (query_id, embedding) the most similar row (id, embedding,
    threshold), exactly, and the number of rows whose cosine is at least their threshold. A query does not meet its own
    id; one that meets no row has a null id and no links. All queries meet all rows, in blocks."""
    asked = queries.where(usable("embedding", dim)).select("query_id", "embedding")
    q = asked.select(F.lit(0).alias("all"), F.col("query_id").alias("id"), "embedding")
    r = rows.where(usable("embedding", dim)).select(F.lit(0).alias("all"), "id", "embedding", "threshold")

    def search(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(held):
            held = held.sort_values("id", kind="stable")
            unit = lambda s: (m := np.stack(s.to_numpy()).astype(np.float64)) / np.linalg.norm(m, axis=1, keepdims=True)
            ids, base, least = held.id.to_numpy(), unit(held.embedding), held.threshold.to_numpy()
            for lo in range(0, len(asked), 512):
                part = asked.iloc[lo : lo + 512]
                cos = unit(part.embedding) @ base.T
                cos[part.id.to_numpy()[:, None] == ids] = -3
                best = np.argmax(cos.round(9), axis=1)
                score = cos[np.arange(len(part)), best]
                met = np.nonzero(score > -2)[0]
                out.append((part.id.to_numpy()[met].astype(object), ids[best[met]].astype(object), score[met], (cos >= least).sum(axis=1)[met]))
        if not out:
            return pd.DataFrame()
        return pd.DataFrame(dict(zip(("query_id", "id", "score", "n"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    found = blockwise(q, r, ["all"], "id", search, "query_id string, id string, score double, n bigint", block_rows)
    best = F.min_by(F.struct("id", "score"), F.struct((-F.round("score", 9)).alias("s"), "id"))
    found = found.groupBy("query_id").agg(best.alias("b"), F.sum("n").alias("n_links")).select("query_id", "b.*", "n_links")
    return asked.select("query_id").join(found, "query_id", "left").select("query_id", "id", "score", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


def gate(neighbours: DataFrame, merge: float = 0.85, link: float = 0.5) -> DataFrame:
    """query_id, decision (merge, link, novel), max_similarity, nearest_id (null if novel), density of each query's
    five nearest (query_id, id, score). The limits rise with the density of the neighbourhood; only greater similarity
    passes them. Queries without neighbours are not in the result: they are novel."""
    top = top_k(neighbours, 5, ["query_id"], F.desc("score"), "id")
    a = top.groupBy("query_id").agg(F.avg("score").alias("density"), F.greatest(F.lit(0.0), F.max("score")).alias("max_similarity"), F.max_by("id", "score").alias("best"))
    shift = (F.col("density") - 0.5) * 0.15
    decision = F.when(F.col("max_similarity") > clamp(merge + shift, 0.70, 0.95), "merge").when(F.col("max_similarity") > clamp(link + shift, 0.35, 0.65), "link").otherwise("novel")
    return a.select("query_id", decision.alias("decision"), "max_similarity", F.when(decision != "novel", F.col("best")).alias("nearest_id"), "density")


def bm25(docs: DataFrame, queries: DataFrame, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """query_id, id, score: the k best rows of docs (id, text) for each query (query_id, text), a query's tokens joined
    by OR. score = x / (x + 1) of the BM25 sum x; idf is at least 1e-6. Rows that share no token aren't found."""
    toks = docs.select("id", tokenize("text").alias("t"))
    postings = toks.select("id", F.size("t").alias("dl"), F.explode("t").alias("token")).groupBy("id", "token").agg(F.count("*").alias("tf"), F.max("dl").alias("dl"))
    stats = toks.agg(F.count("*").alias("n"), F.avg(F.size("t")).alias("avgdl"))
    asked = queries.select("query_id", F.explode(tokenize("text")).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("qf"))
    hits = postings.join(asked.select("token").distinct(), "token", "left_semi")
    df = hits.groupBy("token").agg(F.count("*").alias("df"))
    s = hits.join(df, "token").join(asked, "token").crossJoin(F.broadcast(stats))  # one row
    idf = F.greatest(F.lit(1e-6), F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    part = F.col("qf") * idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scored = s.groupBy("query_id", "id").agg(F.sum(part).alias("x")).select("query_id", "id", (F.col("x") / (F.col("x") + 1)).alias("score"))
    return top_k(scored, k, ["query_id"], F.desc(F.round("score", 9)), "id")


def lexical(docs: DataFrame, text: Column, k: int) -> DataFrame:
    """docs with score: of each token of the query 2 if the name has it, else 1.5 if a tag has it, else 1 if the
    definition has it, as a share of twice the tokens; the k best above 0."""
    tokens = tokenize(text)
    has = lambda c, t: F.coalesce(F.lower(c).contains(t), F.lit(False))
    worth = lambda t: F.when(has(F.col("name"), t), 2.0).when(F.coalesce(F.exists("tags", lambda g: F.lower(g).contains(t)), F.lit(False)), 1.5).when(has(F.col("definition"), t), 1.0).otherwise(0.0)
    scored = docs.withColumn("score", F.aggregate(tokens, F.lit(0.0), lambda s, t: s + worth(t)) / (2 * F.size(tokens)))
    return scored.where("score > 0").orderBy(F.desc("score"), "id").limit(k)


def spread(seeds: DataFrame, edges: DataFrame, depth: int = 2, decay: float = 0.5, query: DataFrame | None = None, rows: DataFrame | None = None) -> DataFrame:
    """id, score, hops, path: the greatest activation of each record over all paths of at most `depth` edges from the
    seeds (id, score); of equal scores the shorter, then the smaller path. A step multiplies by decay and weight, and,
    if a query vector (one row with `query`) and the records' vectors (id, embedding) are given, by the cosine of query
    and target, 0.1 at least: 0.1 for a vector that is not usable, 1 for a record without one."""
    if query is not None and rows is not None:
        dim = F.size("query")
        likeness = F.when(usable("embedding", dim), F.greatest(F.lit(0.1), cosine("embedding", "query"))).when(F.size("embedding") > 0, 0.1).otherwise(1.0)
        factor = rows.crossJoin(F.broadcast(query.select("query").limit(1))).select(F.col("id").alias("target_id"), likeness.alias("factor"))  # one row
        edges = edges.join(factor, "target_id", "left").withColumn("weight", F.col("weight") * F.coalesce("factor", F.lit(1.0)))
    level = seeds.select("id", "score", F.lit(0).alias("hops"), F.array("id").alias("path"))
    found = level
    step = edges.select(F.col("source_id").alias("id"), "target_id", "weight")
    for hop in range(1, depth + 1):
        level = level.join(step, "id").select(F.col("target_id").alias("id"), (F.col("score") * decay * F.col("weight")).alias("score"), F.lit(hop).alias("hops"), F.concat("path", F.array("target_id")).alias("path"))
        level = best_path(level)  # one row a record, so that a hub's paths do not multiply
        found = found.unionByName(level)
    return best_path(found)


def best_path(paths: DataFrame) -> DataFrame:
    order = F.struct((-F.round("score", 12)).alias("a"), "hops", "path")
    return paths.groupBy("id").agg(F.min_by(F.struct("score", "hops", "path"), order).alias("p")).select("id", "p.*")


def borda(ranked: DataFrame) -> DataFrame:
    """id, votes, points, score over several ranked lists (anchor, id, score): a list of n gives n points to its first,
    1 to its last. Order: votes, points."""
    w = Window.partitionBy("anchor")
    points = F.count("*").over(w) - F.row_number().over(w.orderBy(F.desc("score"), "id")) + 1
    return ranked.withColumn("points", points).groupBy("id").agg(F.count("*").alias("votes"), F.sum("points").alias("points"), F.max("score").alias("score"))
