import datetime as dt

import numpy as np
import pytest

from memlattice.llm import clusters as C
from memlattice.llm import neighbours as N
from memlattice.vectors import one_per_id

DIM = 16
T0 = dt.datetime(2025, 7, 1)
KIND = "id string, namespace string, embedding array<float>, updated_at timestamp, vec string, unit string"


def grouped(n_groups, size, seed=0, noise=0.25):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(n_groups, DIM))
    m = np.repeat(centres, size, axis=0) + noise * draw.normal(size=(n_groups * size, DIM))
    return m.astype(np.float32)


def frame(spark, rows):
    return spark.createDataFrame(rows, KIND).repartition(3)


def rows_of(m, ns=lambda i: "n"):
    return [(f"i{i:05}", ns(i), [float(x) for x in v], T0, "", "") for i, v in enumerate(m)]


def cosines(m):
    u = m.astype(np.float64) / np.linalg.norm(m.astype(np.float64), axis=1, keepdims=True)
    return u @ u.T


def test_recall_of_nearest_is_high(spark):
    m = grouped(300, 12, noise=0.4)
    df = one_per_id(frame(spark, rows_of(m)), DIM)
    got = {}
    for r in N.nearest(df, DIM, 5, sample_rows=1500).collect():
        got.setdefault(r.id, []).append((r.rank, r.neighbour, r.score))
    c = cosines(m)
    np.fill_diagonal(c, -2)
    want = np.argsort(-c, axis=1)[:, :5]
    hits = sum(len({n for _, n, _ in got[f"i{i:05}"]} & {f"i{j:05}" for j in w}) for i, w in enumerate(want))
    assert hits / want.size >= 0.9
    assert all([r for r, _, _ in sorted(v)] == [1, 2, 3, 4, 5] for v in got.values())


def test_copies_ties_and_dirty_vectors(spark):
    rows = [(f"c{i:02}", "n", [1.0] + [0.0] * (DIM - 1), T0, "", "") for i in range(20)]
    rows += [("null", "n", None, T0, "", ""), ("short", "n", [1.0], T0, "", ""), ("zero", "n", [0.0] * DIM, T0, "", ""), (None, "n", [1.0] * DIM, T0, "", "")]
    rows += [("nan", "n", [float("nan")] * DIM, T0, "", ""), ("lone", "n", [0.0] * (DIM - 1) + [2.0], T0, "", ""), rows[0]]
    near = N.nearest(one_per_id(frame(spark, rows), DIM), DIM, 5, least=0.5).collect()
    by = {}
    for r in near:
        by.setdefault(r.id, set()).add(r.neighbour)
    assert by["c00"] == {"c01", "c02", "c03", "c04", "c05"} and by["c19"] == {"c00", "c01", "c02", "c03", "c04"}
    assert set(by) == {f"c{i:02}" for i in range(20)}


@pytest.mark.parametrize("operator", ["nearest", "clusters"])
def test_empty_table(spark, operator):
    df = one_per_id(frame(spark, []), DIM, "namespace")
    options = spark.createDataFrame([], "namespace string, threshold double")
    assert (N.nearest(df, DIM) if operator == "nearest" else C.clusters(df, DIM, options)).count() == 0


def test_balanced_parts():
    m = grouped(40, 25)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    label = N.balanced_parts(m, N.neighbour_graph(m, 10), 8)
    assert np.bincount(label, minlength=8).max() <= 1.1 * len(m) / 8 + 1


def clusters_by_force(m, ns, limit):
    c = cosines(m)
    out = {}
    for i in range(len(m)):
        like = [j for j in range(len(m)) if ns(i) == ns(j) and c[i, j] >= limit(ns(i))]
        if len(like) > 1:
            out[f"i{i:05}"] = f"i{min(like):05}"
    return out


def test_clusters_equal_brute_force(spark):
    draw = np.random.default_rng(3)
    m = np.vstack([grouped(120, 4, noise=0.12), draw.normal(size=(300, DIM)).astype(np.float32) * 3])
    ns = lambda i: "ab"[i // 4 % 2] if i < 480 else None
    limit = lambda n: 0.9
    options = spark.createDataFrame([("a", 0.9), ("b", None)], "namespace string, threshold double")
    got = {r.id: r.cluster_id for r in C.clusters(one_per_id(frame(spark, rows_of(m, ns)), DIM, "namespace"), DIM, options, 0.9).collect()}
    want = clusters_by_force(m, ns, limit)
    c = cosines(m)
    cliques = {k: v for k, v in want.items() if all(c[int(k[1:]), int(o[1:])] >= 0.9 for o, w in want.items() if w == v)}
    assert sum(got.get(k) == v for k, v in cliques.items()) >= 0.99 * len(cliques) and len(cliques) > 100
    assert all(c[int(x[1:]), int(y[1:])] >= 0.9 - 1e-6 for x in got for y in got if got[x] == got[y])


def test_copies_are_a_cluster_with_typical_members(spark):
    rows = [(f"c{i}", None, [1.0] + [0.0] * (DIM - 1), T0, "", "") for i in range(6)] + [("z", None, [0.0, 1.0] + [0.0] * (DIM - 2), T0, "", "")]
    options = spark.createDataFrame([(None, 0.8)], "namespace string, threshold double")
    members = C.clusters(one_per_id(frame(spark, rows), DIM, "namespace"), DIM, options)
    assert {(r.id, r.cluster_id) for r in members.collect()} == {(f"c{i}", "c0") for i in range(6)}
    (row,) = C.described(members).collect()
    assert (row.cluster_id, row.n_members, row.typical) == ("c0", 6, "c0 c1 c2")


def test_mixture_finds_the_number_of_components(spark):
    draw = np.random.default_rng(5)
    m = np.vstack([draw.normal(size=(300, 3)) * 0.3 + c for c in ([3, 0, 0], [-3, 0, 0], [0, 4, 0])])
    df = spark.createDataFrame([([float(x) for x in v],) for v in m], "x array<float>")
    mixture, scores = C.fit_mixture(df, len(m), 3, [1, 3, 8], steps=12)
    assert min(scores, key=scores.get) == 3 and len(mixture.weight) == 3
    assert np.allclose(sorted(mixture.weight), [1 / 3] * 3, atol=0.02)


def test_what_leaves_a_chain_is_grouped_again(spark):
    arc = lambda degrees: [float(np.cos(np.radians(degrees))), float(np.sin(np.radians(degrees)))] + [0.0] * (DIM - 2)
    rows = [(f"c{i}", "n", arc(30 * i), T0, "", "") for i in range(6)] + [("far", "n", [0.0] * (DIM - 1) + [1.0], T0, "", "")]
    options = spark.createDataFrame([("n", float(np.cos(np.radians(35))))], "namespace string, threshold double")
    got = {r.id: r.cluster_id for r in C.clusters(one_per_id(frame(spark, rows), DIM, "namespace"), DIM, options).collect()}
    assert got == {"c0": "c0", "c1": "c0", "c2": "c2", "c3": "c2", "c4": "c4", "c5": "c4"}


def test_leads_over_many_steps(spark):
    chain = [(f"r{i + 1:02}", f"r{i:02}") for i in range(20)] + [("z", "r20"), ("z", "q")]
    edges = spark.createDataFrame(chain + [(r, r) for r in {x for e in chain for x in e}], "rep string, lead string")
    assert {r.lead for r in C.smallest_reached(edges).collect()} == {"q"}
