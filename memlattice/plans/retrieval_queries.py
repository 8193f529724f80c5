"""Queries over the engine's records, part two: vectors, text search, graph retrieval and the steps of consolidation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlattice.functions import hooks
from memlattice.functions import scoring as S
from memlattice.functions import text as T
from memlattice.operators import graph, updates, walks
from memlattice.operators import retrieval as R
from memlattice.plans import memory_queries as Q
from memlattice.plans import model as M
from memlattice.plans.model import with_sql
from memlattice.tables import materialize, table
from memlattice.vectors import usable

QUERIES: dict = {}
ORACLE: dict = {}
DIM = 128
_OK = "len(embedding) = 128 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
_VEC = f"""vm AS (SELECT *, embedding::double[] AS v FROM mem WHERE {_OK}), vo AS (SELECT *, embedding::double[] AS v FROM obs WHERE {_OK}),
kn AS (SELECT m.id, list_cosine_similarity(m.v, p.v) AS score, m.* EXCLUDE (id) FROM vm m, (SELECT v FROM vo ORDER BY id LIMIT 1) p WHERE NOT coalesce(m.faded, false)),
asked AS (SELECT id, v FROM vo WHERE ('0x' || substr(id, 5, 8))::bigint % 50 = 0),
nb AS (SELECT a.id AS query_id, m.id, list_cosine_similarity(a.v, m.v) AS score FROM asked a, vm m),
lim AS (SELECT m.id, coalesce(o.cluster_threshold, 0.70) AS threshold FROM mem m LEFT JOIN dream_options o ON o.namespace = m.namespace)
"""
DAYS, RECALL = Q._DAYS, Q._R


def query(ctes: str = "", sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = with_sql(ctes, "").rstrip() + ",\n" + _VEC + sql
        return f

    return register


def memory_vectors(spark, d) -> DataFrame:
    return M.memories(spark, d).where(usable("embedding", DIM))


def probes(spark, d, n: int = 1) -> DataFrame:
    """The first n usable observations: the vectors that are searched for."""
    return M.observations(spark, d).where(usable("embedding", DIM)).orderBy("id").limit(n).select(F.col("id").alias("anchor"), F.col("embedding").alias("query"))


def asked(spark, d) -> DataFrame:
    """The stated query set: observations whose number is divisible by 50."""
    number = F.conv(F.substring("id", 5, 8), 16, 10).cast("bigint")
    return M.observations(spark, d).where(number % 50 == 0).select(F.col("id").alias("query_id"), "embedding")


def recall_now():
    return S.retrievability(F.col("fsrs.stability"), S.days_since("fsrs.last_review"))


@query("mem obs", "SELECT id, score, 1 - score AS distance FROM kn ORDER BY score DESC, id LIMIT 10")
def knn(spark, d):
    return R.nearest(memory_vectors(spark, d), probes(spark, d), 10).select("id", "score", "distance")


@query("mem obs", "SELECT * FROM nb QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) <= 3")
def knn_batch(spark, d):
    return R.nearest_batch(asked(spark, d), memory_vectors(spark, d).select("id", "embedding"), DIM, 3)


@query("mem obs edg", "SELECT e.id, list_cosine_similarity(a.v, b.v) AS cosine FROM edg e JOIN vm a ON lower(a.id) = e.source_id JOIN vm b ON lower(b.id) = e.target_id")
def cosine(spark, d):
    """Likeness of the ends of each edge."""
    v = memory_vectors(spark, d).select(F.lower("id").alias("k"), "embedding")
    e = M.edges(spark, d).select("id", "source_id", "target_id")
    e = e.join(v.select(F.col("k").alias("source_id"), F.col("embedding").alias("a")), "source_id").join(v.select(F.col("k").alias("target_id"), F.col("embedding").alias("b")), "target_id")
    return e.select("id", S.cosine("a", "b").alias("cosine"))


_GATE = """, t AS (SELECT * FROM nb QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) <= 5),
g AS (SELECT query_id, avg(score) AS density, greatest(0, max(score)) AS max_similarity, first(id ORDER BY score DESC, id) AS best FROM t GROUP BY query_id),
gate AS (SELECT query_id, density, max_similarity, CASE WHEN max_similarity > greatest(0.70, least(0.95, 0.85 + (density - 0.5) * 0.15)) THEN 'merge'
  WHEN max_similarity > greatest(0.35, least(0.65, 0.5 + (density - 0.5) * 0.15)) THEN 'link' ELSE 'novel' END AS decision, best FROM g)"""


@query("mem obs", _GATE + " SELECT query_id, decision, max_similarity, CASE WHEN decision <> 'novel' THEN best END AS nearest_id, density, floor((1 - max_similarity) * 1000 + 0.5) / 1000 AS prediction_error FROM gate")
def pe_gate(spark, d):
    near = R.nearest_batch(asked(spark, d), memory_vectors(spark, d).select("id", "embedding"), DIM, 5)
    return R.gate(near).withColumn("prediction_error", S.rounded(1 - F.col("max_similarity"), 3))


@query(
    "mem obs",
    """, s AS (SELECT o.id AS query_id, m.id, list_cosine_similarity(o.v, m.v) AS score, lim.threshold FROM vo o, vm m JOIN lim ON lim.id = m.id),
a AS (SELECT query_id, arg_max(struct_pack(id := id, score := score), struct_pack(s := round(score, 9), k := -rank)) AS b, count(*) FILTER (score >= threshold) AS n_links FROM (SELECT *, rank() OVER (ORDER BY id) AS rank FROM s) GROUP BY query_id)
SELECT vo.id AS query_id, b.id AS id, b.score AS score, coalesce(n_links, 0) AS n_links FROM vo LEFT JOIN a ON a.query_id = vo.id""",
)
def similarity_join(spark, d):
    """Every usable observation with its nearest memory and its number of memories at or above the cluster threshold of
    the memory's namespace."""
    m = memory_vectors(spark, d).select("id", "namespace", "embedding").join(F.broadcast(cluster_thresholds(spark, d)), "namespace", "left")  # one row a namespace
    m = m.select("id", "embedding", F.coalesce("threshold", F.lit(0.70)).alias("threshold"))
    return R.similarity_links(M.observations(spark, d).select(F.col("id").alias("query_id"), "embedding"), m, DIM)


@query(
    "mem obs",
    """, r AS (SELECT id, v FROM vm WHERE NOT coalesce(faded, false) ORDER BY updated_at DESC, id LIMIT 30),
p AS (SELECT r.id AS q, m.id AS o, list_cosine_similarity(r.v, m.v) AS s FROM r JOIN vm m ON m.id <> r.id QUALIFY row_number() OVER (PARTITION BY r.id ORDER BY round(s, 9) DESC, m.id) <= 10)
SELECT DISTINCT least(q, o) AS id_a, greatest(q, o) AS id_b, floor(s * 1000 + 0.5) / 1000 AS similarity FROM p WHERE s >= 0.85""",
)
def find_duplicates(spark, d):
    m = memory_vectors(spark, d)
    newest = m.where(~F.coalesce("faded", F.lit(False))).orderBy(F.desc("updated_at"), "id").limit(30).select(F.col("id").alias("query_id"), "embedding")
    near = R.nearest_batch(newest, m.select("id", "embedding"), DIM, 10, least=0.85)
    return near.select(F.least("query_id", "id").alias("id_a"), F.greatest("query_id", "id").alias("id_b"), S.rounded(F.col("score"), 3).alias("similarity")).distinct()


_DOCS = "concat_ws(' ', name, definition, array_to_string(tags, ' '))"
_BM25 = f""", qt AS (SELECT id AS query_id, unnest(regexp_extract_all(lower(title), '[a-z0-9_]{{2,}}')) AS token FROM thr WHERE ('0x' || substr(id, 5, 8))::bigint % 50 = 0),
qc AS (SELECT query_id, token, count(*) AS qf FROM qt GROUP BY ALL),
dt AS (SELECT id, regexp_extract_all(lower({_DOCS}), '[a-z0-9_]{{2,}}') AS t FROM mem WHERE NOT coalesce(faded, false)),
st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM dt),
po AS (SELECT id, token, count(*) AS tf, max(dl) AS dl FROM (SELECT id, len(t) AS dl, unnest(t) AS token FROM dt) GROUP BY ALL),
dq AS (SELECT token, count(*) AS df FROM po GROUP BY token),
sc AS (SELECT query_id, id, sum(qf * greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS x FROM qc JOIN po USING (token) JOIN dq USING (token), st GROUP BY ALL)"""


def searchable(spark, d) -> DataFrame:
    m = M.memories(spark, d).where(~F.coalesce("faded", F.lit(False)))
    return m.select("id", F.concat_ws(" ", "name", "definition", F.array_join("tags", " ")).alias("text"))


@query("mem obs thr", _BM25 + " SELECT query_id, id, x / (x + 1) AS score FROM sc QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(x / (x + 1), 9) DESC, id) <= 5")
def bm25(spark, d):
    asked_ = M.threads(spark, d).where(F.conv(F.substring("id", 5, 8), 16, 10).cast("bigint") % 50 == 0).select(F.col("id").alias("query_id"), F.col("title").alias("text"))
    return R.bm25(searchable(spark, d), asked_, 5)


@query(
    "mem obs",
    """, s AS (SELECT id, (CASE WHEN contains(lower(name), 'memory') THEN 2.0 WHEN len(list_filter(tags, lambda g: contains(lower(g), 'memory'))) > 0 THEN 1.5 WHEN contains(lower(definition), 'memory') THEN 1.0 ELSE 0 END
  + CASE WHEN contains(lower(name), 'session') THEN 2.0 WHEN len(list_filter(tags, lambda g: contains(lower(g), 'session'))) > 0 THEN 1.5 WHEN contains(lower(definition), 'session') THEN 1.0 ELSE 0 END) / 4::double AS score
  FROM mem WHERE NOT coalesce(faded, false)) SELECT id, score FROM s WHERE score > 0 ORDER BY score DESC, id LIMIT 20""",
)
def lexical_search(spark, d):
    m = M.memories(spark, d).where(~F.coalesce("faded", F.lit(False)))
    return R.lexical(m, F.lit("Memory: session"), 20).select("id", "score")


_PROBE = ", q AS (SELECT id, content, v FROM vo ORDER BY id LIMIT 1)"
_HOPS = """, fac AS (SELECT lower(mem.id) AS id, CASE WHEN vm.v IS NOT NULL THEN greatest(0.1, list_cosine_similarity(vm.v, q.v)) WHEN len(mem.embedding) > 0 THEN 0.1 ELSE 1.0 END AS f FROM mem LEFT JOIN vm ON vm.id = mem.id, q),
step AS (SELECT source_id, target_id, 0.5 * weight * f AS w FROM edg JOIN fac ON fac.id = target_id),
l1 AS (SELECT target_id AS id, score * w AS score, [s.id, target_id] AS path FROM seeds s JOIN step e ON e.source_id = s.id QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY round(score * w, 12) DESC, s.id) = 1),
l2 AS (SELECT target_id AS id, score * w AS score, list_append(path, target_id) AS path FROM l1 JOIN step e ON e.source_id = l1.id QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY round(score * w, 12) DESC, path) = 1),
act AS (SELECT id, score, hops FROM (SELECT id, score, 0 AS hops, [id] AS path FROM seeds UNION ALL SELECT id, score, 1, path FROM l1 UNION ALL SELECT id, score, 2, path FROM l2)
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(score, 12) DESC, hops, path) = 1)"""
_ONE_HOP = _HOPS.replace(" UNION ALL SELECT id, score, 2, path FROM l2", "")
_SPREAD = _PROBE + ", seeds AS (SELECT lower(id) AS id, score FROM kn ORDER BY score DESC, id LIMIT 10)" + _HOPS
_FOUND = """, qc AS (SELECT token, count(*) AS qf FROM (SELECT unnest(regexp_extract_all(lower(content), '[a-z0-9_]{2,}')) AS token FROM q) GROUP BY token),
dt AS (SELECT id, regexp_extract_all(lower(concat_ws(' ', name, definition, array_to_string(tags, ' '))), '[a-z0-9_]{2,}') AS t FROM mem WHERE NOT coalesce(faded, false)),
st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM dt),
po AS (SELECT id, token, count(*) AS tf, max(dl) AS dl FROM (SELECT id, len(t) AS dl, unnest(t) AS token FROM dt) GROUP BY ALL),
dq AS (SELECT token, count(*) AS df FROM po GROUP BY token),
sc AS (SELECT id, sum(qf * greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS x FROM qc JOIN po USING (token) JOIN dq USING (token), st GROUP BY id),
hits AS (SELECT id, x / (x + 1) AS own FROM sc ORDER BY round(x / (x + 1), 9) DESC, id LIMIT 15),
near AS (SELECT id, score FROM kn ORDER BY score DESC, id LIMIT 15),
seeds AS (SELECT lower(id) AS id, score FROM near UNION ALL
  SELECT lower(hits.id), CASE WHEN vm.v IS NOT NULL THEN list_cosine_similarity(vm.v, q.v) ELSE own END FROM hits LEFT JOIN vm ON vm.id = hits.id, q WHERE hits.id NOT IN (SELECT id FROM near))"""


def spread_from(spark, d, seeds: DataFrame, probe: DataFrame, depth: int) -> DataFrame:
    """Activation from seeds (id, score) over the graph with regard to a query vector (one row with `query`). The edges
    are computed once for all hops."""
    edges = materialize(M.edges(spark, d).select("source_id", "target_id", "weight"), "edges")
    return R.spread(seeds, edges, depth, query=probe, rows=M.memories(spark, d).select(F.lower("id").alias("id"), "embedding"))


def ranked(spark, d, activated: DataFrame, limit: int, *also: str) -> DataFrame:
    """id, composite of activated memories (id, score): likeness, recall and salience; the best `limit`."""
    m = M.memories(spark, d).where("fsrs.stability > 0 and salience is not null").withColumn("k", F.lower("id"))
    scored = activated.withColumnRenamed("id", "k").join(m, "k").withColumn("composite", F.col("score") * recall_now() * (0.5 + 0.5 * F.col("salience")))
    return scored.select("id", "composite", *also).orderBy(F.desc(F.round("composite", 9)), "id").limit(limit)


@query("mem obs edg", _SPREAD + " SELECT id, score, hops FROM act")
def spread_activation(spark, d):
    probe = materialize(probes(spark, d), "probe")
    seeds = R.nearest(memory_vectors(spark, d), probe, 10).select(F.lower("id").alias("id"), "score")
    return spread_from(spark, d, seeds, probe, 2).select("id", "score", "hops")


@query("mem obs edg", _PROBE + _FOUND + _HOPS + f" SELECT m.id, a.score * {RECALL} * (0.5 + 0.5 * m.salience) AS composite FROM act a JOIN mem m ON lower(m.id) = a.id WHERE a.score >= 0.3 AND m.fsrs.stability > 0 AND m.salience IS NOT NULL ORDER BY round(composite, 9) DESC, m.id LIMIT 5")
def hybrid_query(spark, d, limit: int = 5, min_score: float = 0.3, category: str | None = None):
    """Nearest neighbours and what text search finds besides, spread over the graph with regard to the query, filtered by
    least score and category, ranked by likeness, recall and salience. The first usable observation is the query, by its
    vector and its content."""
    first = M.observations(spark, d).where(usable("embedding", DIM)).orderBy("id").limit(1)
    probe = materialize(first.select(F.col("id").alias("query_id"), F.col("content").alias("text"), F.col("embedding").alias("query")), "probe")
    k = max(3 * limit, 15)
    near = materialize(R.nearest(memory_vectors(spark, d), probe, k).select("id", "score"), "near")
    found = R.bm25(searchable(spark, d), probe.select("query_id", "text"), k).select("id", F.col("score").alias("own")).join(near, "id", "left_anti")
    found = found.join(M.memories(spark, d).select("id", "embedding"), "id").crossJoin(F.broadcast(probe.select("query")))  # one row
    found = found.select("id", F.when(usable("embedding", DIM), S.cosine("embedding", "query")).otherwise(F.col("own")).alias("score"))
    seeds = materialize(near.unionByName(found).select(F.lower("id").alias("id"), "score"), "seeds")
    a = spread_from(spark, d, seeds, probe, 2).where(F.col("score") >= min_score).select("id", "score")
    if category is not None:
        a = a.join(M.memories(spark, d).where(F.col("category") == category).select(F.lower("id").alias("id")), "id", "left_semi")
    return ranked(spark, d, a, limit)


@query("mem obs", f", n AS (SELECT * FROM kn ORDER BY score DESC, id LIMIT 20) SELECT id, salience * {RECALL} AS rank, substring(definition, 1, 80) || CASE WHEN length(definition) > 80 THEN '…' ELSE '' END AS snippet FROM n WHERE fsrs.stability > 0 AND salience IS NOT NULL ORDER BY round(rank, 9) DESC, id LIMIT 3")
def context_l0(spark, d):
    n = R.nearest(memory_vectors(spark, d), probes(spark, d), 20).where("fsrs.stability > 0 and salience is not null")
    return n.select("id", (F.col("salience") * recall_now()).alias("rank"), F.concat(F.substring("definition", 1, 80), F.when(F.length("definition") > 80, "…").otherwise("")).alias("snippet")).orderBy(F.desc(F.round("rank", 9)), "id").limit(3)


@query(
    "mem obs edg",
    f""", n AS (SELECT id, score * {RECALL} * (0.5 + 0.5 * salience) AS composite FROM (SELECT * FROM kn ORDER BY score DESC, id LIMIT 15) WHERE fsrs.stability > 0 AND salience IS NOT NULL),
l AS (SELECT source_id, string_agg(target_id, ' ' ORDER BY created_at, id) AS links FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY created_at, id) AS r FROM edg) WHERE r <= 5 GROUP BY source_id)
SELECT n.id, composite, coalesce(links, '') AS links FROM n LEFT JOIN l ON l.source_id = lower(n.id)""",
)
def context_l1(spark, d):
    """The nearest with at most five links each."""
    n = R.nearest(memory_vectors(spark, d), probes(spark, d), 15).where("fsrs.stability > 0 and salience is not null").select("id", F.lower("id").alias("source_id"), (F.col("score") * recall_now() * (0.5 + 0.5 * F.col("salience"))).alias("composite"))
    e = M.edges(spark, d).join(F.broadcast(n.select("source_id")), "source_id", "left_semi")  # 15 rows
    firsts = R.top_k(e, 5, ["source_id"], "created_at", "id").groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("created_at", "id", "target_id"))).alias("l"))
    return n.join(firsts, "source_id", "left").select("id", "composite", F.coalesce(F.array_join(F.transform("l", lambda x: x["target_id"]), " "), F.lit("")).alias("links"))


_ANCHORS = """, an AS (SELECT id AS anchor, v FROM vo ORDER BY id LIMIT 4),
li AS (SELECT anchor, m.id, list_cosine_similarity(m.v, an.v) AS score FROM vm m, an QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY round(score, 9) DESC, m.id) <= 10),
bo AS (SELECT *, count(*) OVER (PARTITION BY anchor) - row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) + 1 AS points FROM li)"""


@query("mem obs", _ANCHORS + " SELECT id, count(*) AS votes, sum(points)::bigint AS points, max(score) AS score FROM bo GROUP BY id ORDER BY votes DESC, points DESC, id LIMIT 10")
def multi_anchor(spark, d):
    near = R.nearest_batch(probes(spark, d, 4).select(F.col("anchor").alias("query_id"), F.col("query").alias("embedding")), memory_vectors(spark, d).select("id", "embedding"), DIM, 10)
    return R.borda(near.withColumnRenamed("query_id", "anchor")).orderBy(F.desc("votes"), F.desc("points"), "id").limit(10)


@query(
    "mem obs edg",
    _PROBE
    + _ANCHORS
    + """, seeds AS (SELECT lower(id) AS id, score FROM (SELECT id, count(*) AS votes, sum(points) AS points, max(score) AS score FROM bo GROUP BY id ORDER BY votes DESC, points DESC, id LIMIT 10))"""
    + _HOPS
    + f""" SELECT m.id, a.score * {RECALL} * (0.5 + 0.5 * m.salience) AS composite, hops, category, confidence, fsrs.state AS state, memory_origin, (SELECT count(*) FROM edg WHERE source_id = a.id) AS n_links
FROM act a JOIN mem m ON lower(m.id) = a.id WHERE m.fsrs.stability > 0 AND m.salience IS NOT NULL""",
)
def context_l2(spark, d):
    """The richest tier: what several formulations of a question agree on, spread over the graph, with the memories'
    details. The first usable observations are the formulations, the first of them the question."""
    probe = materialize(probes(spark, d), "probe")
    seeds = materialize(multi_anchor(spark, d).select(F.lower("id").alias("id"), "score"), "seeds")
    a = materialize(spread_from(spark, d, seeds, probe, 2).select(F.col("id").alias("k"), "score", "hops"), "activated")
    links = M.edges(spark, d).groupBy(F.col("source_id").alias("k")).agg(F.count("*").alias("n_links"))
    m = M.memories(spark, d).where("fsrs.stability > 0 and salience is not null").withColumn("k", F.lower("id"))
    rows = a.join(m, "k").join(links, "k", "left").withColumn("composite", F.col("score") * recall_now() * (0.5 + 0.5 * F.col("salience")))
    return rows.select("id", "composite", "hops", "category", "confidence", F.col("fsrs.state").alias("state"), "memory_origin", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


@query(
    "mem obs edg",
    """, n AS (SELECT id, score, v FROM kn ORDER BY score DESC, id LIMIT 10), q AS (SELECT v FROM vo ORDER BY id LIMIT 1),
l AS (SELECT * FROM edg QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY created_at, id) <= 5),
c AS (SELECT n.id, i, avg(m.v[i]) AS x FROM n JOIN l ON l.source_id = lower(n.id) JOIN vm m ON lower(m.id) = l.target_id, range(1, 129) t(i) GROUP BY ALL),
a AS (SELECT n.id, list(0.6 * n.v[i] + 0.4 * c.x ORDER BY i) AS v FROM n JOIN c USING (id) GROUP BY n.id)
SELECT n.id, coalesce(list_cosine_similarity(a.v, q.v), n.score) AS score FROM n LEFT JOIN a USING (id), q""",
)
def gnn_rerank(spark, d):
    """The nearest, scored anew with 0.6 of their own vector and 0.4 of the mean of their first five neighbours'."""
    q = probes(spark, d)
    n = R.nearest(memory_vectors(spark, d), q, 10).select("id", F.lower("id").alias("source_id"), "score", "embedding")
    e = M.edges(spark, d).join(F.broadcast(n.select("source_id")), "source_id", "left_semi")  # 10 rows
    e = R.top_k(e, 5, ["source_id"], "created_at", "id").select("source_id", "target_id")
    v = memory_vectors(spark, d).select(F.lower("id").alias("target_id"), F.col("embedding").alias("v"))
    near = v.join(F.broadcast(e), "target_id").select("source_id", F.posexplode("v").alias("i", "x"))  # 50 rows; only their vectors become rows
    mean = near.groupBy("source_id", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    mean = mean.groupBy("source_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("mean"))
    both = n.join(mean, "source_id", "left").crossJoin(F.broadcast(q.select("query")))  # one row
    mixed = F.zip_with("embedding", "mean", lambda a, b: 0.6 * a.cast("double") + 0.4 * b)
    return both.select("id", F.coalesce(S.cosine(mixed, F.col("query")), "score").alias("score"))


_RECENT = f""", re AS (SELECT * FROM obs WHERE created_at >= (SELECT max(created_at) FROM obs) - INTERVAL 24 HOUR ORDER BY created_at DESC, id LIMIT 10),
rv AS (SELECT list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS u FROM (SELECT embedding::double[] AS e FROM re WHERE {_OK})),
q AS (SELECT list(x ORDER BY i) AS v FROM (SELECT i, avg(u[i]) AS x FROM rv, range(1, 129) t(i) GROUP BY i) HAVING count(*) > 0),
seeds AS (SELECT lower(m.id) AS id, list_cosine_similarity(m.v, q.v) AS score FROM vm m, q WHERE NOT coalesce(m.faded, false) ORDER BY score DESC, m.id LIMIT 10)"""


@query("mem obs edg", _RECENT + _ONE_HOP + f" SELECT m.id, a.score * (1 + 0.3 * exp(-{DAYS('m.updated_at')} / 30)) * {RECALL} AS rank FROM act a JOIN mem m ON lower(m.id) = a.id WHERE m.fsrs.stability > 0 ORDER BY round(rank, 9) DESC, m.id LIMIT 5")
def predict(spark, d, hours: int = 24, k: int = 5):
    """Memories that the latest observations make likely to be needed: these are found by the mean direction of the ten
    newest observations of the last `hours` up to the newest one, spread by one step, and ranked by recency and recall.
    None if there are no such observations with a usable embedding."""
    o = M.observations(spark, d)
    since = o.agg((F.max("created_at") - F.expr(f"interval {hours} hours")).alias("since"))  # one row
    recent = o.crossJoin(F.broadcast(since)).where("created_at >= since").orderBy(F.desc("created_at"), "id").limit(10).where(usable("embedding", DIM))
    unit = F.transform("embedding", lambda x: x.cast("double") / F.sqrt(S.dot("embedding", "embedding")))
    mean = recent.select(F.posexplode(unit).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("x")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("query"))
    probe = materialize(mean.where(F.size("query") > 0), "probe")  # DIM numbers, one row at most
    seeds = R.nearest(memory_vectors(spark, d), probe, 2 * k).select(F.lower("id").alias("id"), "score")
    a = spread_from(spark, d, seeds, probe, 1).withColumnRenamed("id", "k")
    m = M.memories(spark, d).where("fsrs.stability > 0").withColumn("k", F.lower("id"))
    rank = F.col("score") * (1 + 0.3 * F.exp(-S.days_since("updated_at") / 30)) * recall_now()
    return a.join(m, "k").select("id", rank.alias("rank")).orderBy(F.desc(F.round("rank", 9)), "id").limit(k)


@query("mem obs", "SELECT kn.namespace, id, score FROM kn JOIN dream_options o ON o.namespace = kn.namespace AND o.queryable WHERE score >= 0.1 QUALIFY row_number() OVER (PARTITION BY kn.namespace ORDER BY score DESC, id) <= 3")
def query_cross(spark, d):
    """The nearest of each namespace that may be queried."""
    open_ = table(spark, d, "dream_options").where("queryable").select("namespace")
    m = memory_vectors(spark, d).where(~F.coalesce("faded", F.lit(False))).join(open_, "namespace", "left_semi")
    scored = m.crossJoin(F.broadcast(probes(spark, d))).select("namespace", "id", S.cosine("embedding", "query").alias("score")).where("score >= 0.1")  # one row
    return R.top_k(scored, 3, ["namespace"], F.desc("score"), "id")


@query(
    "mem obs edg",
    """, s AS (SELECT min(source_id) AS id FROM edg), b AS (SELECT source_id AS x, target_id AS y FROM edg UNION SELECT target_id, source_id FROM edg),
n1 AS (SELECT DISTINCT y AS id FROM b JOIN s ON s.id = x WHERE y NOT IN (SELECT id FROM s)), n2 AS (SELECT DISTINCT y AS id FROM b JOIN n1 ON n1.id = x WHERE y NOT IN (SELECT id FROM s UNION SELECT id FROM n1))
SELECT id, 0 AS hops FROM s UNION ALL SELECT id, 1 FROM n1 UNION ALL SELECT id, 2 FROM n2""",
)
def neighbors(spark, d):
    e = M.edges(spark, d)
    return graph.layers(e, e.agg(F.min("source_id").alias("id")), 2)


@query()
def fiedler(spark, d):
    """The algebraic connectivity of the graph of all memories, a row."""
    e = M.edges(spark, d)
    value = graph.fiedler(e, vertices=M.memories(spark, d).select(F.lower("id").alias("id")))
    return e.agg(F.count("*").alias("n_edges")).withColumn("fiedler", F.lit(value))


@query(
    "mem obs edg",
    """, r AS (SELECT id, v, row_number() OVER (ORDER BY updated_at DESC, id) AS n FROM (SELECT * FROM vm ORDER BY updated_at DESC, id LIMIT 15))
SELECT a.id AS id_a, b.id AS id_b, list_cosine_similarity(a.v, b.v) AS similarity FROM r a JOIN r b ON a.n < b.n WHERE list_cosine_similarity(a.v, b.v) >= 0.2
  AND NOT EXISTS (SELECT 1 FROM edg WHERE (source_id = lower(a.id) AND target_id = lower(b.id)) OR (source_id = lower(b.id) AND target_id = lower(a.id)))""",
)
def edge_candidates(spark, d):
    """Pairs of the fifteen newest memories that are alike but not linked either way."""
    m = memory_vectors(spark, d).orderBy(F.desc("updated_at"), "id").limit(15).select("id", "embedding", F.struct((-F.unix_micros("updated_at")).alias("a"), "id").alias("n"))
    a, b = (m.select(*[F.col(c).alias(f"{c}_{s}") for c in m.columns]) for s in "ab")
    pairs = a.join(F.broadcast(b), F.col("n_a") < F.col("n_b")).withColumn("similarity", S.cosine("embedding_a", "embedding_b")).where("similarity >= 0.2")  # 15 rows
    linked = M.edges(spark, d).select(F.least("source_id", "target_id").alias("x"), F.greatest("source_id", "target_id").alias("y"))
    pairs = pairs.withColumn("x", F.least(F.lower("id_a"), F.lower("id_b"))).withColumn("y", F.greatest(F.lower("id_a"), F.lower("id_b")))
    return pairs.join(linked, ["x", "y"], "left_anti").select("id_a", "id_b", "similarity")


_CLUSTER = """, o AS (SELECT id, embedding, created_at FROM obs WHERE NOT processed ORDER BY created_at, id LIMIT 50),
c AS (SELECT o.id, m.id AS memory_id, list_cosine_similarity(o.v, m.v) AS score FROM (SELECT vo.id, v FROM vo JOIN o USING (id)) o, vm m WHERE NOT coalesce(m.faded, false) QUALIFY row_number() OVER (PARTITION BY o.id ORDER BY round(score, 9) DESC, m.id) = 1),
deg AS (SELECT source_id, count(*) AS n FROM edg GROUP BY source_id),
cl AS (SELECT o.id, CASE WHEN score >= threshold AND NOT (coalesce(n, 0) < 2 AND score < threshold + 0.10) THEN memory_id END AS memory_id, score
  FROM o LEFT JOIN c USING (id) LEFT JOIN lim ON lim.id = memory_id LEFT JOIN deg ON source_id = lower(memory_id))"""


def cluster_thresholds(spark, d) -> DataFrame:
    """namespace, threshold of the namespaces that have one."""
    return table(spark, d, "dream_options").where("cluster_threshold is not null").select("namespace", F.col("cluster_threshold").alias("threshold"))


def clustered(spark, d, least: float = 0.70, margin: float = 0.10) -> DataFrame:
    """The oldest unprocessed observations with the memory that each belongs to, or none: the nearest one, if it is near
    enough; a memory with fewer than two links must be nearer by the margin. The limit is that of the memory's namespace
    (observations have none), `least` where that has none. Observations without a usable embedding belong to no memory."""
    o = M.observations(spark, d).where(~F.col("processed")).orderBy("created_at", "id").limit(50).select(F.col("id").alias("query_id"), "embedding")
    m = memory_vectors(spark, d).where(~F.coalesce("faded", F.lit(False)))
    near = R.nearest_batch(o, m.select("id", "embedding"), DIM, 1).join(m.select("id", "namespace"), "id")
    near = near.join(F.broadcast(cluster_thresholds(spark, d)), "namespace", "left")  # one row a namespace
    degree = M.edges(spark, d).groupBy(F.col("source_id").alias("k")).agg(F.count("*").alias("n"))
    near = near.withColumn("k", F.lower("id")).join(degree, "k", "left")
    limit = F.coalesce("threshold", F.lit(least))
    held = (F.col("score") >= limit) & ~((F.coalesce("n", F.lit(0)) < 2) & (F.col("score") < limit + margin))
    near = near.select("query_id", F.when(held, F.col("id")).alias("memory_id"), "score")
    return o.select("query_id").join(near, "query_id", "left").select(F.col("query_id").alias("id"), "memory_id", "score")


@query("mem obs edg", _CLUSTER + " SELECT id, memory_id, score FROM cl")
def dream_cluster(spark, d):
    return clustered(spark, d)


@query("mem obs edg", _CLUSTER + " SELECT memory_id, count(*) AS n, string_agg(obs.content, ' | ' ORDER BY obs.created_at, obs.id) AS evidence FROM cl JOIN obs USING (id) WHERE memory_id IS NOT NULL GROUP BY memory_id")
def cluster_evidence(spark, d):
    c = clustered(spark, d).where("memory_id is not null").join(M.observations(spark, d).select("id", "content", "created_at"), "id")
    c = c.groupBy("memory_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("created_at", "id", "content"))).alias("e"))  # 50 in all
    return c.select("memory_id", "n", F.array_join(F.transform("e", lambda x: x["content"]), " | ").alias("evidence"))


@query("mem obs edg", _CLUSTER + " SELECT id, content, 0.5::double AS confidence FROM cl JOIN obs USING (id) WHERE memory_id IS NULL AND coalesce(content_type, 'declarative') IN ('declarative', 'reflective') ORDER BY obs.created_at, id LIMIT 10")
def dream_create(spark, d):
    """Observations that belong to no memory become memories of their own."""
    c = clustered(spark, d).where("memory_id is null").select("id").join(M.observations(spark, d), "id")
    c = c.where(F.coalesce("content_type", F.lit("declarative")).isin("declarative", "reflective")).orderBy("created_at", "id").limit(10)
    return c.select("id", "content", F.lit(0.5).alias("confidence"))


@query()
def dream_score(spark, d):
    """New schedules of the memories that are due, by their rating; nothing else of them changes."""
    m = M.memories(spark, d).where("fsrs.stability > 0").where(S.due(F.col("fsrs.state"), F.col("fsrs.stability"), F.col("fsrs.last_review"))).withColumn("k", F.lower("id"))
    m = m.join(Q.contradicted(spark, d).select(F.col("id").alias("k"), F.lit(True).alias("c")), "k", "left")
    rating = S.consolidation_rating(S.days_since("last_accessed"), F.col("fsrs.state"), F.col("last_retrieval_score"), F.col("last_hop_count"), F.coalesce("c", F.lit(False)))
    m = m.withColumn("rating", rating)
    new = S.schedule(F.col("fsrs.state"), F.col("fsrs.stability"), F.col("fsrs.difficulty"), F.col("rating"), S.days_since("fsrs.last_review"))
    return m.select("id", "rating", new.alias("s"), (F.col("fsrs.reps") + 1).alias("reps"), F.col("fsrs.lapses").alias("lapses")).select("id", "rating", "s.*", "reps", "lapses")


_RATED = Q._CONTRADICTED + f""", b AS (SELECT m.id, c.id IS NOT NULL AS contradicted, last_retrieval_score AS sc, last_hop_count AS hop, CASE WHEN {DAYS('last_accessed')} <= CASE WHEN fsrs.state = 'relearning' THEN 1 ELSE 3 END THEN 3 ELSE 2 END AS base,
  fsrs.state AS st, fsrs.stability AS s0, fsrs.difficulty AS d0, fsrs.reps + 1 AS reps, fsrs.lapses AS lapses, {RECALL} AS r FROM mem m LEFT JOIN contra c ON c.id = lower(m.id)
  WHERE fsrs.stability > 0 AND fsrs.state IN ('review', 'learning', 'relearning') AND (fsrs.last_review IS NULL OR {DAYS('fsrs.last_review')} >= greatest(CASE WHEN fsrs.state = 'review' THEN 1.0 ELSE 0.5 END, 0.8 * fsrs.stability))),
u AS (SELECT *, least(4, base + CASE WHEN sc > 0.92 AND coalesce(hop, 0) = 0 THEN 1 ELSE 0 END) AS up FROM b),
g AS (SELECT *, greatest(1, greatest(1, up - CASE WHEN coalesce(sc < 0.75, false) OR coalesce(hop > 0, false) THEN 1 ELSE 0 END) - contradicted::int)::int AS g FROM u),
d AS (SELECT *, greatest(1::double, least(10::double, d0 - 1.0651 * (g - 3) + 0.0589 * (7.2102 - d0))) AS difficulty FROM g)
SELECT id, g AS rating, CASE WHEN g = 1 THEN 1.9395 * power(difficulty, -0.11) * (power(s0 + 1, 0.2918) - 1) * exp((1 - r) * 0.5)
  ELSE s0 * (exp(1.506) * (11 - difficulty) * power(s0, -0.14) * (exp((1 - r) * 1.0036) - 1) * CASE g WHEN 4 THEN 2.0 ELSE 1.0 END) + s0 END AS stability, difficulty,
  greatest(1, floor(stability + 0.5))::bigint AS interval_days, CASE WHEN g = 1 THEN 'relearning' ELSE 'review' END AS state, reps, lapses FROM d"""
ORACLE["dream_score"] = with_sql("mem edg sig", _RATED)


@query("mem obs", ", n AS (SELECT id, v FROM vm ORDER BY updated_at DESC, id LIMIT 60), s AS (SELECT n.id, max(list_cosine_similarity(n.v, m.v)) AS best FROM n JOIN vm m ON m.id <> n.id GROUP BY n.id) SELECT id, best, best < 0.88 AS is_new FROM s")
def novelty_gate(spark, d):
    m = memory_vectors(spark, d)
    n = m.orderBy(F.desc("updated_at"), "id").limit(60).select(F.col("id").alias("query_id"), "embedding")
    near = R.nearest_batch(n, m.select("id", "embedding"), DIM, 1)
    return near.select(F.col("query_id").alias("id"), F.col("score").alias("best"), (F.col("score") < 0.88).alias("is_new"))


@query(
    "mem obs",
    """, gl AS (SELECT id, v FROM vm WHERE category = 'goal'),
t AS (SELECT gl.id, m.category, list_cosine_similarity(gl.v, m.v) AS s FROM gl JOIN vm m ON m.id <> gl.id QUALIFY row_number() OVER (PARTITION BY gl.id ORDER BY round(s, 9) DESC, m.id) <= 3)
SELECT id, 1 - coalesce(max(s) FILTER (category IS NULL OR category <> 'goal'), 0) AS forward_error FROM t GROUP BY id""",
)
def goal_forward_pe(spark, d):
    """One less the likeness of the nearest memory that is no goal, of every goal's three nearest."""
    m = memory_vectors(spark, d)
    goals = m.where("category = 'goal'").select(F.col("id").alias("query_id"), "embedding")
    near = R.nearest_batch(goals, m.select("id", "embedding"), DIM, 3).join(m.select("id", "category"), "id")
    other = F.when(F.coalesce(F.col("category") != "goal", F.lit(True)), F.col("score"))
    return near.groupBy(F.col("query_id").alias("id")).agg((1 - F.coalesce(F.max(other), F.lit(0.0))).alias("forward_error"))


@query("mem obs op", ", k AS (SELECT DISTINCT id, lower(unnest(keywords)) AS k FROM op), m AS (SELECT id, unnest(list_distinct(regexp_extract_all(lower(coalesce(definition, '')), '[a-z0-9_]{2,}'))) AS k FROM mem) SELECT m.id, count(DISTINCT k.k) AS n_keywords, count(*) AS n_entries FROM m JOIN k ON k.k = m.k GROUP BY m.id")
def keyword_match(spark, d):
    """Memories whose definition has keywords of the operations log, by an inverted index on both sides."""
    k = M.ops(spark, d).select(F.col("id").alias("entry"), F.explode("keywords").alias("k")).select("entry", F.lower("k").alias("k")).distinct()
    per_word = k.groupBy("k").agg(F.count("*").alias("n"))  # so that a common word is one row
    m = M.memories(spark, d).select("id", F.explode(F.array_distinct(T.tokenize("definition"))).alias("k"))
    return m.join(per_word, "k").groupBy("id").agg(F.count("*").alias("n_keywords"), F.sum("n").alias("n_entries"))


@query(
    "mem obs",
    r""", w AS (SELECT doc_id, list_filter(string_split_regex(regexp_replace(coalesce(text, ''), '[#>\[\]|`]', ' ', 'g'), '\s+'), lambda x: x <> '') AS w FROM documents),
e AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w),
f AS (SELECT doc_id, 2 * i AS pos, CASE WHEN regexp_matches(w[i], '^[A-Z][a-z]{2,}') THEN regexp_replace(w[i], '[^a-zA-Z]', '', 'g') END AS p FROM e
  UNION ALL SELECT doc_id, 2 * i + 1, trim(regexp_replace(w[i] || ' ' || w[i + 1], '[^a-zA-Z ]', '', 'g')) FROM e WHERE i < len(w)),
g AS (SELECT doc_id, p, min(pos) AS pos FROM f WHERE p IS NOT NULL AND (pos % 2 = 0 OR length(p) > 5) GROUP BY doc_id, p),
k AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY pos) <= 30),
h AS (SELECT doc_id, string_agg(p, ' | ' ORDER BY pos) AS phrases FROM k GROUP BY doc_id)
SELECT doc_id, coalesce(phrases, '') AS phrases FROM documents LEFT JOIN h USING (doc_id)""",
)
def candidate_phrases(spark, d):
    """Phrases of each document that could name a memory: capitalised words and pairs of words, the first thirty."""
    return table(spark, d, "documents").select("doc_id", F.array_join(T.phrases("text"), " | ").alias("phrases"))


@query("mem obs", """, s AS (SELECT query_id, nb.id, nb.score FROM nb JOIN mem USING (id) WHERE NOT coalesce(faded, false) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(nb.score, 9) DESC, nb.id) <= 10)
SELECT query_id, s.id, regexp_replace(lower(name), '\\s+', '-', 'g') AS tag, floor(score * 100 + 0.5) / 100 AS score FROM s JOIN mem USING (id) WHERE score >= 0.6 AND name IS NOT NULL""")
def suggest_tags(spark, d):
    """Tags for the stated observations: the names of the ten nearest memories, if they are near enough."""
    m = memory_vectors(spark, d).where(~F.coalesce("faded", F.lit(False)))
    near = R.nearest_batch(asked(spark, d), m.select("id", "embedding"), DIM, 10, least=0.6).join(m.where("name is not null").select("id", "name"), "id")
    return near.select("query_id", "id", F.regexp_replace(F.lower("name"), r"\s+", "-").alias("tag"), S.rounded(F.col("score"), 2).alias("score"))


def named_memories(spark, d, embed: hooks.Embed = hooks.hashed_embedding) -> DataFrame:
    """Memories with embeddings made anew of their names."""
    m = M.memories(spark, d).where(~F.coalesce("faded", F.lit(False))).select("id", "name", "embedding")
    return hooks.embedded(m, F.col("name"), embed, least=1).where(usable("embedding", DIM))


@query()
def suggest_links(spark, d, embed: hooks.Embed = hooks.hashed_embedding, least: float = 0.75):
    """Memories that the stated documents (number divisible by 50) could link to: for each candidate phrase the memory with the nearest name, if it is near
    enough; of several phrases for a memory the first. All embeddings are the given model's, here the stand-in's."""
    docs = table(spark, d, "documents").where(F.col("doc_id") % 50 == 0)
    found = docs.select("doc_id", F.posexplode(T.phrases("text")).alias("pos", "phrase")).where("phrase <> ''")
    kinds = materialize(found.select("phrase").distinct().select(F.col("phrase").alias("query_id"), embed(F.col("phrase")).alias("embedding")), "phrases")
    m = materialize(named_memories(spark, d, embed), "names")
    near = R.nearest_batch(kinds, m.select("id", "embedding"), DIM, 1, least=least).withColumnRenamed("query_id", "phrase")
    first = R.top_k(found.join(near, "phrase"), 1, ["doc_id", "id"], "pos")
    return first.join(m.select("id", "name"), "id").select("doc_id", "phrase", "id", "name", S.rounded(F.col("score"), 2).alias("score"))


_RELATION = "CASE WHEN kind = 'project' THEN 'supports' WHEN kind = 'research' THEN 'extends' WHEN kind IS NULL THEN 'related' ELSE kind END"


def thread_proposals(spark, d) -> DataFrame:
    """source_id, target_id, relation: an edge that each thread proposes from its first to its third memory."""
    at = lambda i: F.lower(F.btrim(F.get("related_memory_ids", F.lit(i))))
    relation = F.when(F.col("kind") == "project", "supports").when(F.col("kind") == "research", "extends").otherwise(F.coalesce("kind", F.lit("related")))
    return M.threads(spark, d).where(F.size("related_memory_ids") >= 3).select(at(0).alias("source_id"), at(2).alias("target_id"), relation.alias("relation"))


@query(
    "thr mem obs edg",
    f""", p AS (SELECT lower(trim(related_memory_ids[1])) AS a, lower(trim(related_memory_ids[3])) AS b, {_RELATION} AS relation FROM thr WHERE len(related_memory_ids) >= 3
  UNION SELECT target_id, source_id, relation FROM edg UNION SELECT source_id, source_id, relation FROM edg),
v AS (SELECT * FROM p WHERE a <> b AND a IN (SELECT lower(id) FROM mem) AND b IN (SELECT lower(id) FROM mem) AND relation IN ('extends','refines','contradicts','tensions-with','questions','supports','exemplifies','caused','related'))
SELECT a AS source_id, b AS target_id, relation FROM v WHERE NOT EXISTS (SELECT 1 FROM edg e WHERE (e.source_id = v.a AND e.target_id = v.b) OR (e.source_id = v.b AND e.target_id = v.a))""",
)
def edge_proposals_valid(spark, d):
    """Of proposed edges (threads' first to third memory, the reverse of each edge, and loops) those of a known relation
    between two memories that no edge links either way."""
    e = M.edges(spark, d).select("source_id", "target_id", "relation")
    reverse = e.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), "relation")
    proposed = thread_proposals(spark, d).unionByName(reverse).unionByName(e.withColumn("target_id", F.col("source_id")))
    known = M.memories(spark, d).select(F.lower("id").alias("k"))
    valid = proposed.where("source_id <> target_id").where(F.col("relation").isin(*M.RELATIONS)).distinct()
    for end in ("source_id", "target_id"):
        valid = valid.join(known.withColumnRenamed("k", end), end, "left_semi")
    linked = e.unionByName(reverse).select("source_id", "target_id")
    return valid.join(linked, ["source_id", "target_id"], "left_anti").select("source_id", "target_id", "relation")


@query("mem obs edg", """, r AS (SELECT id FROM mem ORDER BY updated_at DESC, id LIMIT 100)
SELECT r.id, count(e.id) AS n_related, string_agg(m.definition, ' ' ORDER BY e.created_at, e.id) AS evidence FROM r JOIN (SELECT * FROM edg WHERE relation = 'related' QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY created_at, id) <= 10) e ON e.source_id = lower(r.id) JOIN mem m ON lower(m.id) = e.target_id WHERE m.definition IS NOT NULL GROUP BY r.id""")
def refine_evidence(spark, d):
    """Definitions of at most ten related memories of each of the newest."""
    m = M.memories(spark, d)
    newest = m.orderBy(F.desc("updated_at"), "id").limit(100).select("id", F.lower("id").alias("source_id"))
    e = M.edges(spark, d).where("relation = 'related'").withColumnRenamed("id", "edge").join(F.broadcast(newest), "source_id")  # 100 rows
    e = R.top_k(e, 10, ["source_id"], "created_at", "edge").join(m.select(F.lower("id").alias("target_id"), "definition").where("definition is not null"), "target_id")
    e = e.groupBy("id").agg(F.count("*").alias("n_related"), F.array_sort(F.collect_list(F.struct("created_at", "edge", "definition"))).alias("x"))  # ten at most
    return e.select("id", "n_related", F.array_join(F.transform("x", lambda s: s["definition"]), " ").alias("evidence"))


# Changes

_VOTES = """, tv AS (SELECT lower(trim(unnest(related_memory_ids))) AS k, created_at AS since, priority >= 0.5 AS helpful FROM thr),
v AS (SELECT mem.id, coalesce(helpful, false) AS helpful, row_number() OVER (PARTITION BY mem.id ORDER BY since NULLS FIRST, coalesce(helpful, false)) AS n FROM tv JOIN mem ON lower(mem.id) = tv.k),
vl AS (SELECT id, list(CASE WHEN helpful THEN 0.05::double ELSE -0.10 END ORDER BY n) AS l, count(*) AS n_votes, count(*) FILTER (helpful) AS n_helpful FROM v GROUP BY id),
vf AS (SELECT mem.id, n_votes, n_helpful, coalesce(confidence, 0.5) AS confidence_before, list_reduce(list_concat([coalesce(confidence, 0.5)], l), lambda x, y: greatest(0.05::double, least(1.0::double, x + y))) AS confidence_after FROM vl JOIN mem USING (id))"""


def votes(spark, d) -> DataFrame:
    """Each reference of a thread to a memory is a vote, helpful if the thread has priority."""
    t = M.threads(spark, d).select(F.col("created_at").alias("at"), F.coalesce(F.col("priority") >= 0.5, F.lit(False)).alias("helpful"), F.explode("related_memory_ids").alias("k"))
    return t.withColumn("k", F.lower(F.btrim("k"))).join(M.memories(spark, d).select("id", F.lower("id").alias("k")), "k").select("id", "at", "helpful")


@query("mem obs thr", _VOTES + " SELECT mem.id, CASE WHEN vf.id IS NULL THEN confidence ELSE confidence_after END AS confidence, CASE WHEN vf.id IS NULL THEN access_count ELSE coalesce(access_count, 0) + n_helpful END AS access_count FROM mem LEFT JOIN vf USING (id)")
def feedback(spark, d):
    return updates.feedback(M.memories(spark, d), votes(spark, d)).select("id", "confidence", "access_count")


@query("mem obs thr", _VOTES + " SELECT * FROM vf")
def feedback_log(spark, d):
    return updates.feedback_log(M.memories(spark, d), votes(spark, d))


@query("mem obs", "SELECT id, CASE WHEN category = 'topic' THEN greatest(0.1, salience * 0.6) ELSE salience END AS salience, CASE WHEN category = 'topic' THEN true ELSE faded END AS faded, CASE WHEN category = 'topic' THEN 'relearning' ELSE fsrs.state END AS state, fsrs.lapses + CASE WHEN category = 'topic' THEN 1 ELSE 0 END AS lapses FROM mem WHERE fsrs IS NOT NULL AND salience IS NOT NULL")
def forget(spark, d):
    m = M.memories(spark, d).where("fsrs is not null and salience is not null")
    return updates.forget(m, m.where("category = 'topic'").select("id")).select("id", "salience", "faded", F.col("fsrs.state").alias("state"), F.col("fsrs.lapses").alias("lapses"))


@query("mem obs thr", ", a AS (SELECT lower(trim(unnest(related_memory_ids))) AS k FROM thr), n AS (SELECT k, count(*) AS n FROM a GROUP BY k) SELECT id, coalesce(access_count, 0) + coalesce(n, 0) AS access_count FROM mem LEFT JOIN n ON n.k = lower(mem.id) WHERE access_count IS NOT NULL OR n IS NOT NULL")
def touch(spark, d):
    """Each reference from a thread counts as an access."""
    refs = M.threads(spark, d).select(F.explode("related_memory_ids").alias("k")).select(F.lower(F.btrim("k")).alias("k"))
    m = M.memories(spark, d)
    accesses = refs.join(m.select("id", F.lower("id").alias("k")), "k").select("id")
    return updates.touch(m, accesses).where("access_count is not null").select("id", "access_count")


@query("mem obs", _GATE + """ SELECT o.id, CASE WHEN coalesce(decision, 'novel') = 'merge' THEN 'touch' WHEN coalesce(decision, 'novel') = 'novel' AND o.salience >= 0.7 THEN 'create' ELSE 'keep' END AS effect,
  CASE WHEN decision <> 'novel' THEN best END AS memory_id, CASE WHEN max_similarity > 0 THEN floor((1 - max_similarity) * 1000 + 0.5) / 1000 END AS prediction_error,
  coalesce(max_similarity > 0 AND floor((1 - max_similarity) * 1000 + 0.5) / 1000 >= 0.5, false) AS surprising FROM obs o LEFT JOIN gate ON query_id = o.id WHERE ('0x' || substr(o.id, 5, 8))::bigint % 50 = 0""")
def observe(spark, d):
    """What comes of the stated observations."""
    number = F.conv(F.substring("id", 5, 8), 16, 10).cast("bigint")
    new = M.observations(spark, d).where(number % 50 == 0).select("id", "salience")
    gates = R.gate(R.nearest_batch(asked(spark, d), memory_vectors(spark, d).select("id", "embedding"), DIM, 5))
    return updates.observed(new, gates)


_DUPLICATES = ORACLE["find_duplicates"].split("\nSELECT DISTINCT least(q, o)")[0]
ORACLE["merged_duplicates"] = (
    _DUPLICATES.replace("WITH ", "WITH RECURSIVE ", 1)
    + """, pr AS (SELECT DISTINCT least(q, o) AS a, greatest(q, o) AS b, floor(s * 1000 + 0.5) / 1000 AS similarity FROM p WHERE s >= 0.85),
ps AS (SELECT pr.*, coalesce(x.salience, 0) AS sa, coalesce(y.salience, 0) AS sb FROM pr JOIN mem x ON x.id = a JOIN mem y ON y.id = b),
lost AS (SELECT CASE WHEN sa >= sb THEN b ELSE a END AS id, CASE WHEN sa >= sb THEN a ELSE b END AS into_, similarity FROM ps QUALIFY row_number() OVER (PARTITION BY CASE WHEN sa >= sb THEN b ELSE a END ORDER BY similarity DESC, CASE WHEN sa >= sb THEN a ELSE b END) = 1),
way AS (SELECT id, into_ FROM lost UNION ALL SELECT way.id, lost.into_ FROM way JOIN lost ON lost.id = way.into_),
root AS (SELECT id, into_ FROM way WHERE into_ NOT IN (SELECT id FROM lost)),
gain AS (SELECT into_ AS id, flatten(list(coalesce(source_files, []))) AS f, max(access_count) AS a, max(salience) AS s FROM root JOIN mem USING (id) GROUP BY into_)
SELECT mem.id, CASE WHEN mem.id IN (SELECT id FROM lost) THEN 0 WHEN gain.id IS NOT NULL THEN greatest(salience, s) ELSE salience END AS salience, CASE WHEN mem.id IN (SELECT id FROM lost) THEN true ELSE faded END AS faded,
  CASE WHEN gain.id IS NOT NULL THEN greatest(access_count, a) ELSE access_count END AS access_count, CASE WHEN gain.id IS NOT NULL THEN len(list_distinct(list_concat(coalesce(source_files, []), f))) ELSE len(source_files) END AS n_files FROM mem LEFT JOIN gain USING (id)"""
)


@query()
def merged_duplicates(spark, d):
    """All memories, after the newest duplicates were merged."""
    m = M.memories(spark, d)
    return updates.merge_duplicates(m, find_duplicates(spark, d)).select("id", "salience", "faded", "access_count", F.when(F.col("source_files").isNotNull(), F.size("source_files")).cast("bigint").alias("n_files"))


@query("mem obs thr", """, r AS (SELECT lower(trim(related_memory_ids[1])) AS k, next_step AS new_definition, updated_at AS since FROM thr WHERE trim(next_step) <> ''),
k AS (SELECT mem.id, definition, new_definition, since, row_number() OVER (PARTITION BY mem.id ORDER BY since NULLS FIRST, new_definition) AS n, lag(new_definition) OVER (PARTITION BY mem.id ORDER BY since NULLS FIRST, new_definition) AS before FROM r JOIN mem ON lower(mem.id) = r.k)
SELECT id AS concept_id, CASE WHEN n = 1 THEN definition ELSE before END AS old_definition, new_definition FROM k""")
def believe(spark, d):
    """The belief log of revised memories; a thread's next step stands for a new definition of its first memory."""
    t = M.threads(spark, d).where(F.btrim("next_step") != "").select(F.lower(F.btrim(F.get("related_memory_ids", F.lit(0)))).alias("k"), F.col("next_step").alias("new_definition"), F.lit("next step").alias("reason"), F.lit(None).cast("timestamp").alias("valid_from"), F.col("updated_at").alias("at"))
    m = M.memories(spark, d)
    revisions = t.join(m.select("id", F.lower("id").alias("k")), "k").drop("k")
    return updates.believe(m, revisions)[1].select("concept_id", "old_definition", "new_definition")


@query("mem obs thr edg", """, p AS (SELECT DISTINCT lower(trim(related_memory_ids[1])) AS source_id, lower(trim(related_memory_ids[3])) AS target_id, """ + _RELATION + """ AS relation FROM thr WHERE len(related_memory_ids) >= 3)
SELECT source_id, target_id, relation, CASE WHEN source_id IS NULL OR target_id IS NULL THEN 'no ids' WHEN relation NOT IN ('extends','refines','contradicts','tensions-with','questions','supports','exemplifies','caused','related') THEN 'no such relation'
  WHEN source_id NOT IN (SELECT lower(id) FROM mem) THEN 'no such source' WHEN target_id NOT IN (SELECT lower(id) FROM mem) THEN 'no such target' WHEN EXISTS (SELECT 1 FROM edg WHERE edg.source_id = p.source_id AND edg.target_id = p.target_id AND edg.relation = p.relation) THEN 'there already' END AS error FROM p""")
def link(spark, d):
    """Proposed edges with what is wrong with each; a thread proposes one from its first to its third memory."""
    p = thread_proposals(spark, d).withColumn("weight", F.lit(None).cast("double"))
    return updates.linked(M.edges(spark, d), p, M.memories(spark, d).select(F.lower("id").alias("id")), M.RELATIONS).drop("weight")


@query("mem obs sig", f"""{Q._CONTRADICTED.split('contra AS')[0].rstrip().rstrip(',')}, ct AS (SELECT cg.id, sum(floor(0.15 * best * 1000 + 0.5) / 1000) AS taken FROM cg WHERE best > greatest(0.35, least(0.65, 0.5 + (density - 0.5) * 0.15)) GROUP BY cg.id HAVING sum(floor(0.15 * best * 1000 + 0.5) / 1000) > 0)
SELECT mem.id, CASE WHEN ct.id IS NULL THEN confidence ELSE greatest(0.1, coalesce(confidence, 0.5) - taken) END AS confidence FROM mem LEFT JOIN ct USING (id)""")
def contradict(spark, d):
    """Confidence after the open contradictions; the gate's likeness stands for the judge's confidence."""
    m = M.memories(spark, d)
    open_ = M.signals(spark, d).where("type = 'CONTRADICTION' and not resolved")
    v = M.signal_concepts(spark, d, open_, "max_similarity").join(m.select("id", F.lower("id").alias("concept_id")).withColumnRenamed("id", "memory"), "concept_id")
    return updates.contradicted(m, v.select(F.col("memory").alias("id"), F.lit("genuine").alias("verdict"), F.col("max_similarity").alias("confidence"))).select("id", "confidence")


@query("mem obs", _GATE + """, n AS (SELECT o.* FROM obs o LEFT JOIN gate ON query_id = o.id WHERE ('0x' || substr(o.id, 5, 8))::bigint % 50 = 0 AND coalesce(decision, 'novel') = 'novel' AND o.salience >= 0.7)
SELECT id, content AS definition, salience, 0.7::double AS confidence, CASE""" + "".join(f" WHEN regexp_matches(lower(coalesce(content, '')), '{p}') THEN '{n}'" for p, n in T.CATEGORIES) + " ELSE 'observation' END AS category FROM n")
def observe_created(spark, d):
    """The memories that come of the stated observations at once."""
    number = F.conv(F.substring("id", 5, 8), 16, 10).cast("bigint")
    return updates.created_memories(M.observations(spark, d).where(number % 50 == 0), observe(spark, d)).select("id", "definition", "salience", "confidence", "category")


@query("mem obs thr", """SELECT id, trim(next_step) AS content, 'interrogative' AS content_type, 0.5::double AS salience, false AS processed FROM thr WHERE trim(next_step) <> '' UNION ALL SELECT id, trim(resolution), 'speculative', 0.5, false FROM thr WHERE trim(resolution) <> ''
UNION ALL SELECT id, trim(title), NULL, 0.3, false FROM thr WHERE trim(title) <> ''""")
def noted_observations(spark, d):
    """What is wondered, guessed and noticed becomes observations; here threads' next steps, resolutions and titles."""
    t = M.threads(spark, d)
    of = lambda column, kind: updates.noted(t.select("id", F.col(column).alias("content")), kind)
    return of("next_step", "interrogative").unionByName(of("resolution", "speculative")).unionByName(of("title", "raw"))


@query("mem obs edg", _CLUSTER + " SELECT count(memory_id) AS n_clustered, count(*) - count(memory_id) AS n_unclustered, CASE WHEN count(*) = 0 THEN 0 ELSE count(memory_id) / count(*)::double END AS integration_rate FROM cl")
def integration_rate(spark, d):
    """The share of the oldest unprocessed observations that belong to a memory."""
    c = clustered(spark, d).agg(F.count("memory_id").alias("n_clustered"), F.count("*").alias("n"))
    rate = F.when(F.col("n") > 0, F.col("n_clustered") / F.col("n")).otherwise(0.0)
    return c.select("n_clustered", (F.col("n") - F.col("n_clustered")).alias("n_unclustered"), rate.alias("integration_rate"))


_EPISTEMIC = f"""ep AS (SELECT lower(id) AS id, CASE WHEN access_count < 3 THEN 0.3::double ELSE 0 END + CASE WHEN confidence < 0.5 THEN 0.2::double ELSE 0 END + CASE WHEN category = 'goal' THEN 0.4::double ELSE 0 END + CASE WHEN {DAYS('last_accessed')} > 14 THEN 0.2::double ELSE 0 END AS score FROM mem)"""
_DRAW = "('0x' || substr(md5(walk || ':' || {0}), 1, 8))::bigint / 4294967296::double"


def _pick(step: int, rows: str, order: str) -> str:
    """The weighted pick in SQL."""
    return f"(SELECT * FROM (SELECT *, sum(score) OVER (PARTITION BY walk ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS upto, sum(score) OVER (PARTITION BY walk) AS total FROM ({rows})) WHERE upto >= {_DRAW.format(step)} * total QUALIFY row_number() OVER (PARTITION BY walk ORDER BY {order}) = 1)"


_WALKS = f""", {_EPISTEMIC}, pool AS (SELECT * FROM ep WHERE score IS NOT NULL ORDER BY score DESC, id LIMIT 10),
w0 AS (SELECT walk, 0 AS step, id, score, [id] AS path FROM {_pick(0, 'SELECT walk, id, score FROM pool, (SELECT unnest(range(10)) AS walk)', 'id')}),
""" + ", ".join(
    f"w{n} AS (SELECT walk, {n} AS step, target_id AS id, score, list_append(path, target_id) AS path FROM "
    + _pick(n, f"SELECT w.walk, w.path, e.id AS edge, e.target_id, 0.4 * weight + 0.6 * ep.score AS score FROM w{n - 1} w JOIN edg e ON e.source_id = w.id JOIN ep ON ep.id = e.target_id WHERE NOT list_contains(w.path, e.target_id)", "edge") + ")"
    for n in (1, 2, 3)
)


@query("mem obs edg", _WALKS + " SELECT walk, step, id, score FROM w0 UNION ALL SELECT walk, step, id, score FROM w1 UNION ALL SELECT walk, step, id, score FROM w2 UNION ALL SELECT walk, step, id, score FROM w3")
def wander(spark, d):
    """Ten walks of three steps over the graph, drawn to memories that are little known, doubted, goals or long unseen."""
    score = S.epistemic(F.col("access_count"), F.col("confidence"), F.col("category"), S.days_since("last_accessed"))
    scores = materialize(M.memories(spark, d).select(F.lower("id").alias("id"), score.alias("score")), "scores")
    return walks.walks(scores, materialize(M.edges(spark, d).select("id", "source_id", "target_id", "weight"), "edges"))


_GREEDY = ", s0 AS (SELECT id, score, v FROM kn ORDER BY score DESC, id LIMIT 1)" + "".join(
    f", s{n} AS (SELECT m.id, list_cosine_similarity(m.v, s{n - 1}.v) AS score, m.v FROM vm m, s{n - 1} WHERE NOT coalesce(m.faded, false) AND m.id NOT IN ({' UNION ALL '.join(f'SELECT id FROM s{i}' for i in range(n))}) ORDER BY score DESC, m.id LIMIT 1)"
    for n in range(1, 5)
)


@query("mem obs", _GREEDY + " SELECT 0 AS step, id, score FROM s0" + "".join(f" UNION ALL SELECT {n}, id, score FROM s{n}" for n in range(1, 5)))
def wander_similar(spark, d):
    """From the memory nearest to the question on to the most similar one that was not visited, five memories in all."""
    return walks.similarity_walk(materialize(memory_vectors(spark, d).select("id", "embedding", "faded"), "vectors"), materialize(probes(spark, d), "probe"))


@query()
def reembedded(spark, d, embed: hooks.Embed = hooks.hashed_embedding):
    """Memories with their embedding made anew of name and definition, and the size of what the model gave."""
    m = M.memories(spark, d).select("id", "name", "definition", "embedding")
    text = F.concat(T.text_of("name"), F.lit(": "), T.text_of("definition"))
    return hooks.embedded(m, text, embed).select("id", F.size("embedding").alias("n"), S.dot("embedding", "embedding").alias("size"))


@query()
def hyde_search(spark, d, generate: hooks.Generate = hooks.no_answer, embed: hooks.Embed = hooks.hashed_embedding):
    """The memories nearest to a passage that would answer the question (the question itself, as the stand-in gives no
    passage), in the embeddings of the given model."""
    question = M.observations(spark, d).where("length(content) > 0").orderBy("id").limit(1).select(hooks.expanded_query(F.col("content"), generate, embed).alias("query"))
    m = hooks.embedded(M.memories(spark, d).select("id", "definition", "faded", "embedding"), F.col("definition"), embed, least=1)
    return R.nearest(m.where(usable("embedding", DIM)), materialize(question, "question"), 5).select("id", "score")


@query(
    "mem obs edg",
    f""", e AS (SELECT id, CASE WHEN access_count < 3 THEN 0.3::double ELSE 0 END + CASE WHEN confidence < 0.5 THEN 0.2::double ELSE 0 END + CASE WHEN category = 'goal' THEN 0.4::double ELSE 0 END + CASE WHEN {DAYS('last_accessed')} > 14 THEN 0.2::double ELSE 0 END AS s FROM mem)
SELECT source_id, target_id, 0.4 * weight + 0.6 * s AS pull FROM (SELECT DISTINCT source_id, target_id, max(weight) OVER (PARTITION BY source_id, target_id) AS weight FROM edg) JOIN e ON lower(e.id) = target_id
QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY round(0.4 * weight + 0.6 * s, 9) DESC, target_id) <= 10""",
)
def wander_steps(spark, d):
    """Where a walk may go on from each memory: its ten strongest next steps."""
    e = M.edges(spark, d).groupBy("source_id", "target_id").agg(F.max("weight").alias("weight"))
    s = M.memories(spark, d).select(F.lower("id").alias("target_id"), S.epistemic(F.col("access_count"), F.col("confidence"), F.col("category"), S.days_since("last_accessed")).alias("s"))
    steps = e.join(s, "target_id").select("source_id", "target_id", (0.4 * F.col("weight") + 0.6 * F.col("s")).alias("pull"))
    return R.top_k(steps, 10, ["source_id"], F.desc(F.round("pull", 9)), "target_id")


# Consolidation as a whole

_REFINED = _CLUSTER + f""", re AS (SELECT * FROM mem WHERE updated_at >= {Q.NOW} - INTERVAL 7 DAY ORDER BY updated_at DESC, id LIMIT 100),
ev AS (SELECT memory_id AS id, 0 AS kind, obs.created_at AS since, obs.id AS k, content AS e FROM cl JOIN obs USING (id) WHERE memory_id IS NOT NULL
  UNION ALL SELECT re.id, 1, x.created_at, x.id, m.definition FROM re JOIN (SELECT * FROM edg WHERE relation = 'related' QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY created_at, id) <= 10) x ON x.source_id = lower(re.id) JOIN mem m ON lower(m.id) = x.target_id WHERE m.definition IS NOT NULL),
el AS (SELECT id, string_agg(e, ' ' ORDER BY kind, since, k) AS e FROM (SELECT * FROM ev WHERE e IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY kind, since, k) <= 10) GROUP BY id),
nd AS (SELECT re.id, definition AS old_definition, trim(concat_ws(' ', definition, e), ' ' || chr(9) || chr(13) || chr(10)) AS t FROM re JOIN el USING (id)),
nh AS (SELECT *, {Q._HITS} AS hits FROM nd)
SELECT id, old_definition, t AS new_definition FROM nh WHERE t <> trim(coalesce(old_definition, '')) AND length(t) BETWEEN 20 AND 2000 AND regexp_matches(t, '[.!?]["'')\\]]?$') AND NOT regexp_matches(t, '^(#{{1,6}}\\s|\\*\\*)')
  AND NOT ({Q._META}) AND NOT regexp_matches(t, '\\bConcept\\s+[A-Z]\\b') AND hits < 2"""


def refined(spark, d, rewrite=hooks.joined_evidence) -> DataFrame:
    """id, old_definition, new_definition of memories of the last seven days (the newest hundred) whose definition is
    rewritten from at most ten pieces of evidence, observations that belong to them first; rewritings of poor quality are
    left out."""
    m = M.memories(spark, d)
    recent = m.where(F.col("updated_at") >= Q.before(7)).orderBy(F.desc("updated_at"), "id").limit(100).select("id", F.lower("id").alias("source_id"), "definition")
    recent = materialize(recent, "recent")
    own = clustered(spark, d).where("memory_id is not null").join(M.observations(spark, d).select("id", "content", "created_at"), "id")
    own = own.select(F.col("memory_id").alias("id"), F.lit(0).alias("kind"), "created_at", F.col("id").alias("k"), F.col("content").alias("e"))
    e = M.edges(spark, d).where("relation = 'related'").withColumnRenamed("id", "k").join(F.broadcast(recent.select("id", "source_id")), "source_id")  # 100 rows
    e = R.top_k(e, 10, ["source_id"], "created_at", "k").join(m.select(F.lower("id").alias("target_id"), F.col("definition").alias("e")), "target_id")
    both = own.unionByName(e.select("id", F.lit(1).alias("kind"), "created_at", "k", "e")).where("e is not null")
    both = R.top_k(both, 10, ["id"], "kind", "created_at", "k").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("kind", "created_at", "k", "e"))).alias("l"))  # ten at most
    text = F.array_join(F.transform("l", lambda x: x["e"]), " ")
    new = F.btrim(rewrite(F.col("definition"), text), F.lit(" \t\r\n"))
    made = recent.join(both, "id").select("id", F.col("definition").alias("old_definition"), new.alias("new_definition"), text.alias("evidence"))
    bad = T.assess_thought("new_definition", F.concat_ws(" ", "old_definition", "evidence"))
    return made.where((F.col("new_definition") != F.btrim(T.text_of("old_definition"))) & (F.size(bad) == 0)).select("id", "old_definition", "new_definition")


@query("mem obs edg", _REFINED)
def dream_refine(spark, d):
    return refined(spark, d)


_GOOD = f"length(t) BETWEEN 20 AND 2000 AND regexp_matches(t, '[.!?][\"'')\\]]?$') AND NOT regexp_matches(t, '^(#{{1,6}}\\s|\\*\\*)') AND NOT ({Q._META}) AND NOT regexp_matches(t, '\\bConcept\\s+[A-Z]\\b') AND ({Q._HITS}) < 2"


@query(
    "mem obs",
    f""", r AS (SELECT * FROM mem ORDER BY updated_at DESC, id LIMIT 60),
pk AS (SELECT attempt, category, id, definition FROM r, (SELECT unnest(range(5)) AS attempt) WHERE category IS NOT NULL QUALIFY row_number() OVER (PARTITION BY attempt, category ORDER BY md5(attempt || ':' || id), id) = 1),
fr AS (SELECT * FROM pk QUALIFY row_number() OVER (PARTITION BY attempt ORDER BY md5(attempt || ':' || category), category) <= 4),
tx AS (SELECT attempt, string_agg(id, ' ' ORDER BY id) AS ids, trim(coalesce(string_agg(definition, ' ' ORDER BY id), ''), ' ' || chr(9) || chr(13) || chr(10)) AS t FROM fr GROUP BY attempt HAVING count(*) >= 3),
ux AS (SELECT attempt, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM fr JOIN vm USING (id)),
mx AS (SELECT attempt, list(x ORDER BY i) AS v FROM (SELECT attempt, i, avg(u[i]) AS x FROM ux, range(1, 129) t(i) GROUP BY ALL) GROUP BY attempt),
bx AS (SELECT attempt, max(list_cosine_similarity(mx.v, vm.v)) AS best FROM mx, vm WHERE NOT coalesce(faded, false) GROUP BY attempt)
SELECT attempt, ids, coalesce(best, 0) AS nearest, {_GOOD} AND coalesce(best, 0) < 0.88 AS accepted FROM tx LEFT JOIN bx USING (attempt)""",
)
def dream_abstract(spark, d, attempts: int = 5, novel: float = 0.88, abstract=None):
    """Attempts to abstract from memories of different categories: of the sixty newest one of each of up to four
    categories, drawn by a hash; accepted if the text is of good quality and no memory is as near as `novel`. The text
    is the model's of their joined definitions (here these themselves), its vector the mean direction of theirs."""
    m = M.memories(spark, d)
    recent = m.orderBy(F.desc("updated_at"), "id").limit(60).where("category is not null").select("id", "category", "definition", "embedding")
    tried = recent.crossJoin(spark.range(attempts).select(F.col("id").alias("attempt")))  # 60 x attempts rows
    by = lambda c: F.md5(F.concat_ws(":", F.col("attempt"), F.col(c)))
    one = R.top_k(tried, 1, ["attempt", "category"], by("id"), "id")
    four = materialize(R.top_k(one, 4, ["attempt"], by("category"), "category"), "sampled")
    parts = F.array_sort(F.collect_list(F.struct("id", "definition")))  # four at most
    text = four.groupBy("attempt").agg(parts.alias("p")).where(F.size("p") >= 3)
    joined = F.btrim(F.array_join(F.transform("p", lambda x: x["definition"]), " "), F.lit(" \t\r\n"))
    text = text.select("attempt", F.array_join(F.transform("p", lambda x: x["id"]), " ").alias("ids"), joined.alias("evidence"), (abstract(joined) if abstract else joined).alias("t"))
    unit = F.transform("embedding", lambda x: x.cast("double") / F.sqrt(S.dot("embedding", "embedding")))
    mean = four.where(usable("embedding", DIM)).select("attempt", F.posexplode(unit).alias("i", "x")).groupBy("attempt", "i").agg(F.avg("x").alias("x"))
    mean = mean.groupBy("attempt").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda q: q["x"]).alias("query"))  # DIM numbers
    v = memory_vectors(spark, d).where(~F.coalesce("faded", F.lit(False))).select("embedding")
    near = v.crossJoin(F.broadcast(materialize(mean, "means"))).groupBy("attempt").agg(F.max(S.cosine("embedding", "query")).alias("best"))  # `attempts` rows
    good = F.size(T.assess_thought("t", F.col("evidence"), least_grounding=0.1)) == 0
    nearest = F.coalesce("best", F.lit(0.0))
    return text.join(near, "attempt", "left").select("attempt", "ids", nearest.alias("nearest"), (good & (nearest < novel)).alias("accepted"))


@query()
def dream_phase_a(spark, d):
    """What the first half of a consolidation does: observations that find a memory, those that do not, definitions
    rewritten, memories made, and observations that are no statements and are only marked. All its steps see the same
    clusters."""
    c = clustered(spark, d).join(M.observations(spark, d).select("id", "content_type"), "id")
    mark = F.col("memory_id").isNull() & F.coalesce(F.col("content_type").isin("interrogative", "speculative"), F.lit(False))
    a = c.agg(F.count("memory_id").alias("n_clustered"), (F.count("*") - F.count("memory_id")).alias("n_unclustered"), F.count_if(mark).alias("n_marked"))
    return a.crossJoin(dream_refine(spark, d).agg(F.count("*").alias("n_refined"))).crossJoin(dream_create(spark, d).agg(F.count("*").alias("n_created")))  # one row each


@query()
def dream_phase_b(spark, d):
    """What the second half does: pairs of memories to be linked, memories scored anew, and recent memories that are new."""
    counted = lambda f, name: f(spark, d).agg(F.count("*").alias(name))
    new = novelty_gate(spark, d).agg(F.count_if("is_new").alias("n_new"))
    return counted(edge_candidates, "n_candidates").crossJoin(counted(dream_score, "n_scored")).crossJoin(new)  # one row each


_count = lambda name, what="count(*)": f"(SELECT {what} FROM ({ORACLE[name]}))"
ORACLE["dream_phase_a"] = f"""SELECT {_count('dream_cluster', 'count(memory_id)')} AS n_clustered, {_count('dream_cluster', 'count(*) - count(memory_id)')} AS n_unclustered,
  (SELECT count(*) FROM ({ORACLE['dream_cluster']}) c JOIN (SELECT DISTINCT id, content_type FROM observations) o USING (id) WHERE memory_id IS NULL AND content_type IN ('interrogative', 'speculative')) AS n_marked,
  {_count('dream_refine')} AS n_refined, {_count('dream_create')} AS n_created"""
ORACLE["dream_phase_b"] = f"SELECT {_count('edge_candidates')} AS n_candidates, {_count('dream_score')} AS n_scored, {_count('novelty_gate', 'count(*) FILTER (is_new)')} AS n_new"
