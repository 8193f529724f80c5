"""Queries that must take in every row, against brute force on small tables."""

import datetime as dt

import numpy as np
import pytest

from memlattice.operators import graph, retrieval
from memlattice.plans import memory_queries, retrieval_queries

DAY = dt.datetime(2025, 12, 1, tzinfo=dt.UTC)
MEMORY = "id string, namespace string, name string, definition string, category string, salience double, access_count int, updated_at timestamp, last_accessed timestamp, embedding array<float>, tags array<string>, fsrs struct<stability: double, difficulty: double, reps: int, lapses: int, state: string, last_review: timestamp>, faded boolean, last_retrieval_score double, last_hop_count int"
OBSERVATION = "id string, content string, processed boolean, prediction_error double, created_at timestamp, updated_at timestamp, embedding array<float>, content_type string"
THREAD = "id string, related_memory_ids array<string>, created_at timestamp, updated_at timestamp"
OPTIONS = "namespace string, cluster_threshold double, similarity_merge double, similarity_link double"


@pytest.fixture
def tables(spark, tmp_path):
    """Writes tables, given as rows of some of the columns (the others are null), and returns their folder."""

    def write(**given):
        for name, schema in (("memories", MEMORY), ("observations", OBSERVATION), ("threads", THREAD), ("dream_options", OPTIONS)):
            kind = spark.createDataFrame([], schema).schema
            rows = [tuple(r.get(c) for c in kind.names) for r in given.get(name, [])]
            spark.createDataFrame(rows, kind).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def vectors(n, seed=1):
    return np.random.default_rng(seed).normal(size=(n, 128)).astype(np.float32)


def cosines(a, b):
    unit = lambda m: m.astype(np.float64) / np.linalg.norm(m.astype(np.float64), axis=1, keepdims=True)
    return unit(a) @ unit(b).T


def test_every_goal_has_a_forward_error(spark, tables):
    v = vectors(90)
    rows = [{"id": f"m{i:02}", "category": "goal" if i < 60 else "belief", "updated_at": DAY, "embedding": v[i].tolist()} for i in range(90)]
    got = {r.id: r.forward_error for r in retrieval_queries.goal_forward_pe(spark, tables(memories=rows)).collect()}
    cos = cosines(v, v) - 3 * np.eye(90)
    want = {f"m{i:02}": 1 - max([cos[i, j] for j in np.argsort(-cos[i])[:3] if j >= 60], default=0) for i in range(60)}
    assert got == pytest.approx(want, abs=1e-6)


def test_text_search_finds_seeds_that_the_vectors_miss(spark, tables):
    v = vectors(22, 2)
    query, other = v[0], v[1]
    mix = lambda c: (lambda u, w: (c * u + (1 - c * c) ** 0.5 * w).tolist())(query / np.linalg.norm(query), (o := other - query * (other @ query) / (query @ query)) / np.linalg.norm(o))
    fsrs = (10.0, 5.0, 1, 0, "review", dt.datetime(2026, 1, 1, tzinfo=dt.UTC))
    memory = lambda i, vector, text, salience=0.1: {"id": i, "definition": text, "embedding": vector, "salience": salience, "fsrs": fsrs, "updated_at": DAY}
    rows = [memory(f"near{i:02}", mix(0.5 + i / 100), "other words") for i in range(15)]
    rows += [memory("rare-vector", mix(0.45), "the quokka", 1.0), memory("rare-none", None, "a quokka and its wombat", 0.9), memory("rare-far", mix(0.2), "one quokka more", 1.0)]
    rows += [memory("linked", mix(0.9), "elsewhere", 1.0), memory("missed", mix(0.4), "third words", 1.0)]
    rows[-2]["faded"] = True  # found over an edge only
    threads = [{"id": "t", "related_memory_ids": ["x", "y", "z", "near14", "linked"], "created_at": DAY, "updated_at": DAY}]
    rows += [memory(i, None, "") for i in ("x", "y", "z")]
    d = tables(memories=rows, threads=threads, observations=[{"id": "o", "content": "Quokka! Wombat!", "embedding": query.tolist(), "processed": False, "created_at": DAY, "updated_at": DAY}])
    got = {r.id: r.composite for r in retrieval_queries.hybrid_query(spark, d, 30).collect()}
    assert got["rare-vector"] == pytest.approx(0.45, abs=1e-6)
    assert got["rare-none"] > 0.3 * 0.95 and not {"rare-far", "x"} & set(got)
    small = [r.id for r in retrieval_queries.hybrid_query(spark, d).collect()]
    assert len(small) == 5 and small[:2] == ["rare-none", "rare-vector"] and "missed" not in small


def test_spread_with_a_query(spark):
    seeds = spark.createDataFrame([("a", 1.0)], "id string, score double")
    edges = spark.createDataFrame([("a", "like", 1.0), ("a", "unlike", 1.0), ("a", "none", 1.0), ("a", "short", 1.0)], "source_id string, target_id string, weight double")
    rows = spark.createDataFrame([("like", [3.0, 4.0]), ("unlike", [-1.0, 0.0]), ("none", None), ("short", [1.0])], "id string, embedding array<float>")
    query = spark.createDataFrame([([1.0, 0.0],)], "query array<float>")
    got = {r.id: r.score for r in retrieval.spread(seeds, edges, 1, 0.5, query, rows).collect()}
    assert got == pytest.approx({"a": 1.0, "like": 0.3, "unlike": 0.05, "none": 0.5, "short": 0.05})


def test_connectivity_of_all_vertices(spark):
    rng = np.random.default_rng(3)
    kind = "id string, source_id string, target_id string, weight double"
    pairs = {(i, i + 1) for i in range(11)} | {(0, j) for j in range(2, 6)}  # a hub and a long tail
    rows = [(f"{i:03}", f"v{a}", f"v{b}", float(rng.integers(3, 10)) / 10) for i, (a, b) in enumerate(sorted(pairs))]
    laplacian = np.zeros((12, 12))
    for (a, b), (*_, w) in zip(sorted(pairs), rows, strict=True):
        laplacian[[a, b], [b, a]] -= w
        laplacian[[a, b], [a, b]] += w
    edges = spark.createDataFrame(rows, kind).coalesce(1)
    vertices = spark.createDataFrame([(f"v{i}",) for i in range(12)], "id string").coalesce(1)
    assert graph.fiedler(edges, vertices=vertices) == pytest.approx(np.linalg.eigvalsh(laplacian)[1], rel=1e-4)
    alone = spark.createDataFrame([("alone",)], "id string")
    assert graph.fiedler(edges, vertices=vertices.union(alone)) == 0
    two = spark.createDataFrame([("1", "a", "b", 1.0), ("2", "b", "c", 1.0), ("3", "x", "y", 1.0)], kind)
    assert graph.fiedler(two) == 0
    with pytest.raises(ArithmeticError):
        graph.fiedler(edges, 1)


def at(v, cosine, seed=9):
    """A vector of that cosine to v."""
    u, w = (x.astype(np.float64) for x in (v, vectors(1, seed)[0]))
    u /= np.linalg.norm(u)
    w -= u * (w @ u)
    return (cosine * u + (1 - cosine**2) ** 0.5 * w / np.linalg.norm(w)).tolist()


def test_clusters_by_the_limits_of_namespaces(spark, tables):
    v = vectors(3, 4)
    names = ["default", "tooling", "none"]
    memories = [{"id": f"m{i}", "namespace": n, "embedding": v[i].tolist(), "updated_at": DAY} for i, n in enumerate(names)]
    memories += [{"id": i, "updated_at": DAY} for i in ("p", "q")]
    # m1 has two links, the others have none
    threads = [{"id": f"t{i}", "related_memory_ids": ["m1", x], "created_at": DAY, "updated_at": DAY} for i, x in enumerate("pq")]
    cases = {"a": (0, 0.81, "m0"), "b": (0, 0.79, None), "c": (1, 0.83, "m1"), "d": (1, 0.81, None), "e": (2, 0.81, "m2"), "f": (2, 0.5, None)}
    observations = [{"id": i, "embedding": at(v[n], c)} for i, (n, c, _) in cases.items()] + [{"id": "null"}, {"id": "short", "embedding": [1.0]}, {"id": "zero", "embedding": [0.0] * 128}]
    observations = [o | {"content": o["id"], "processed": False, "created_at": DAY, "updated_at": DAY} for o in observations]
    options = [{"namespace": "default", "cluster_threshold": 0.7}, {"namespace": "tooling", "cluster_threshold": 0.82}, {"namespace": "none"}]
    d = tables(memories=memories, threads=threads, observations=observations, dream_options=options)
    want = {i: m for i, (_, _, m) in cases.items()} | {"null": None, "short": None, "zero": None}
    assert {r.id: r.memory_id for r in retrieval_queries.dream_cluster(spark, d).collect()} == want
    assert {r.id for r in retrieval_queries.dream_create(spark, d).collect()} == {i for i, m in want.items() if m is None}
    assert {r.memory_id: r.evidence for r in retrieval_queries.cluster_evidence(spark, d).collect()} == {"m0": "a", "m1": "c", "m2": "e"}


@pytest.mark.parametrize("block_rows", [7, 4096])
def test_links_equal_brute_force(spark, block_rows):
    v, w = vectors(40, 5), vectors(30, 6)
    w[:10] = v[:10] + 0.5 * w[:10]  # alike, above their thresholds or not
    least = [0.70, 0.80, 0.95] * 10
    q = spark.createDataFrame([(f"o{i:02}", x.tolist()) for i, x in enumerate(v)] + [("null", None), ("zero", [0.0] * 128)], "query_id string, embedding array<float>")
    r = spark.createDataFrame([(f"m{i:02}", x.tolist(), least[i]) for i, x in enumerate(w)] + [("bad", [1.0], 0.7)], "id string, embedding array<float>, threshold double")
    got = {x.query_id: (x.id, round(x.score, 6), x.n_links) for x in retrieval.similarity_links(q, r, 128, block_rows).collect()}
    cos = cosines(v, w)
    assert got == {f"o{i:02}": (f"m{c.argmax():02}", round(c.max(), 6), (c >= least).sum()) for i, c in enumerate(cos)} and 0 < sum(x[2] for x in got.values()) < 10


def test_similarity_join_has_every_observation(spark, tables):
    v = vectors(1, 7)[0]
    observations = [{"id": f"obs-{i:08x}", "embedding": at(v, c), "updated_at": DAY} for i, c in enumerate((0.75, 0.85, 0.1))]
    memories = [{"id": f"m{n}", "namespace": n, "embedding": v.tolist(), "updated_at": DAY} for n in ("default", "tooling", "none")]
    options = [{"namespace": "default", "cluster_threshold": 0.7}, {"namespace": "tooling", "cluster_threshold": 0.82}, {"namespace": "none"}]
    d = tables(memories=memories, observations=observations, dream_options=options)
    got = {r.query_id: (r.id, r.n_links) for r in retrieval_queries.similarity_join(spark, d).collect()}
    assert got == {"obs-00000000": ("mdefault", 2), "obs-00000001": ("mdefault", 3), "obs-00000002": ("mdefault", 0)}
    assert [tuple(r) for r in retrieval_queries.similarity_join(spark, tables(observations=observations[:1])).collect()] == [("obs-00000000", None, None, 0)]


def test_open_contradiction_signals_count(spark, tables):
    v = vectors(4, 8)
    fsrs = (1.0, 5.0, 1, 0, "review", dt.datetime(2025, 12, 1, tzinfo=dt.UTC))
    memories = [{"id": f"M{i}", "embedding": v[i].tolist(), "fsrs": fsrs, "last_accessed": dt.datetime(2025, 12, 31, tzinfo=dt.UTC), "updated_at": DAY} for i in range(4)]
    near = lambda i, m, error, processed=False: {"id": i, "embedding": at(v[m], 0.95), "prediction_error": error, "processed": processed, "updated_at": DAY}
    observations = [near("open", 0, 0.9), near("done", 1, 0.9, True), near("surprise", 2, 0.6), near("null", 3, 0.9) | {"embedding": None}, near("novel", 3, 0.9) | {"embedding": at(v[3], 0.1)}]
    d = tables(memories=memories, observations=observations)
    assert [r.id for r in memory_queries.contradicted_ids(spark, d).collect()] == ["m0"]
    want = {"M0": 2, "M1": 3, "M2": 3, "M3": 3}
    assert {r.id: r.rating for r in memory_queries.dream_rating(spark, d).collect()} == want
    assert {r.id: r.rating for r in retrieval_queries.dream_score(spark, d).collect()} == want


def rows_sent(plan):
    """Rows of each table that the plan, which has run, sent to all executors."""
    name = plan.nodeName()
    if name.startswith("BroadcastExchange"):
        yield plan.metrics().apply("numOutputRows").value()
    inner = [plan.executedPlan()] if name == "AdaptiveSparkPlan" else [plan.plan()] if name.endswith("QueryStage") else [plan.children().apply(i) for i in range(plan.children().size())]
    for p in inner:
        yield from rows_sent(p)


def test_rerank_mixes_five_neighbours_and_sends_no_vector_as_rows(spark, tables):
    v = vectors(60, 8)
    memories = [{"id": f"M{i:02}", "updated_at": DAY, "embedding": v[i].tolist()} for i in range(60)]
    near = np.argsort(-cosines(v[:1], v)[0])[:10]
    hub, other, links = int(near[0]), int(near[3]), {}
    links[hub] = [j for j in range(60) if j not in near][:7]  # only the first five count
    links[other] = [int(near[5]), hub]
    threads = [{"id": f"t{i}-{k}", "related_memory_ids": [f"m{i:02}", f"M{j:02} "], "created_at": DAY + dt.timedelta(hours=k), "updated_at": DAY} for i, js in links.items() for k, j in enumerate(js)]
    far = [i for i in range(60) if i not in near]
    threads += [{"id": f"far{i}", "related_memory_ids": [f"m{far[i % 50]:02}", f"m{i % 60:02}"], "created_at": DAY, "updated_at": DAY} for i in range(4000)]
    observation = {"id": "o", "updated_at": DAY, "embedding": v[0].tolist()}
    reranked = retrieval_queries.gnn_rerank(spark, tables(memories=memories, threads=threads, observations=[observation]))
    got = {r.id: r.score for r in reranked.collect()}
    mixed = {int(i): 0.6 * v[i] + 0.4 * v[links[i][:5]].mean(axis=0) if i in links else v[i] for i in map(int, near)}
    assert got == pytest.approx({f"M{i:02}": cosines(m[None], v[:1])[0, 0] for i, m in mixed.items()}, abs=1e-6)
    assert max(rows_sent(reranked._jdf.queryExecution().executedPlan())) <= 60  # before: 128 rows a memory
