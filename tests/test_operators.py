import datetime as dt

import pytest
from pyspark.sql import functions as F

from memlattice.functions import scoring as S
from memlattice.functions import text as T
from memlattice.operators import graph, retrieval
from memlattice.operators.forest import isolation_scores
from memlattice.streaming.pipelines import route


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_cosine(spark):
    arr = lambda *v: F.array(*[F.lit(x) for x in v]).cast("array<float>")
    assert one(spark, S.cosine(arr(1, 0), arr(0.6, 0.8))) == pytest.approx(0.6)
    assert one(spark, S.cosine(arr(0, 0), arr(1, 0))) == 0
    assert one(spark, S.cosine(arr(1, 0), arr(1))) is None


@pytest.mark.parametrize("days", [0.0, 1.0, 9.5, 100.0])
def test_retrievability_falls(spark, days):
    r = one(spark, S.retrievability(F.lit(9.5), F.lit(days)))
    assert r == pytest.approx((1 + (0.9**-2 - 1) * days / 9.5) ** -0.5) and 0 < r <= 1
    assert days != 9.5 or r == pytest.approx(0.9)


def test_schedule_of_a_new_memory(spark):
    s = one(spark, S.schedule(F.lit("new"), F.lit(1.0), F.lit(5.0), F.lit(3), F.lit(0.0)))
    assert (s.stability, s.difficulty, s.interval_days, s.state) == (3.1262, 7.2102, 3, "learning")


NAMES = [("First one. Then more.", "First one"), ("short text", "short text"), (None, ""), ("word " * 30, "word " * 11 + "word…"), ("x" * 80, "x" * 59 + "…")]


@pytest.mark.parametrize("text,name", NAMES)
def test_names(spark, text, name):
    got = one(spark, T.derive_name(F.lit(text).cast("string")))
    assert got == name.strip() and len(got) <= 60


def test_thoughts(spark):
    problems = lambda t, e=None: one(spark, T.assess_thought(F.lit(t), None if e is None else F.lit(e)))
    assert problems("The harbour ledger closes before the ferry leaves.") == []
    assert problems("The memory concept involves a paradigm and is multifaceted.") == ["meta_opener", "generic"]
    assert problems("# Heading") == ["too_short", "no_sentence_end", "markdown"]
    assert problems("Ledger entries follow the harbour ferry.", "ferry harbour ledger entries follow") == []
    assert problems("Ledger entries follow the harbour ferry.", "nothing alike") == ["ungrounded"]


def test_spread_keeps_the_best_path(spark):
    seeds = spark.createDataFrame([("a", 1.0), ("b", 0.1)], "id string, score double")
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 0.2), ("c", "d", 1.0)], "source_id string, target_id string, weight double")
    got = {r.id: (round(r.score, 6), r.hops, r.path) for r in retrieval.spread(seeds, edges).collect()}
    assert got == {"a": (1.0, 0, ["a"]), "b": (0.5, 1, ["a", "b"]), "c": (0.25, 2, ["a", "b", "c"]), "d": (0.05, 2, ["a", "c", "d"])}


def test_gate_limits(spark):
    near = spark.createDataFrame([("q", "x", 0.9), ("q", "y", 0.1), ("r", "x", 0.55), ("s", "x", -0.3)], "query_id string, id string, score double")
    got = {r.query_id: (r.decision, r.nearest_id) for r in retrieval.gate(near).collect()}
    assert got == {"q": ("merge", "x"), "r": ("link", "x"), "s": ("novel", None)}


def test_nearest_batch_in_blocks(spark):
    rows = [(f"i{i:03}", [float(i % 7 + 1), float(i % 5), 1.0]) for i in range(60)] + [("bad", [1.0]), ("null", None)]
    df = spark.createDataFrame(rows, "id string, embedding array<float>")
    q = df.select(F.col("id").alias("query_id"), "embedding").where("query_id < 'i010'")
    small = {tuple(r) for r in retrieval.nearest_batch(q, df, 3, 4, block_rows=7).select("query_id", "id").collect()}
    assert small == {tuple(r) for r in retrieval.nearest_batch(q, df, 3, 4).select("query_id", "id").collect()} and len(small) == 40


def test_borda(spark):
    rows = [("1", "a", 0.9), ("1", "b", 0.8), ("2", "b", 0.7), ("2", "c", 0.6)]
    got = {r.id: (r.votes, r.points) for r in retrieval.borda(spark.createDataFrame(rows, "anchor string, id string, score double")).collect()}
    assert got == {"a": (1, 2), "b": (2, 3), "c": (1, 1)}


def test_graph(spark):
    edges = spark.createDataFrame([("1", "a", "b", 1.0), ("2", "b", "c", 1.0), ("3", "c", "c", 1.0)], "id string, source_id string, target_id string, weight double")
    vertices = spark.createDataFrame([("a",), ("b",), ("c",), ("z",)], "id string")
    assert {tuple(r) for r in graph.degrees(vertices, edges).collect()} == {("a", 1), ("b", 2), ("c", 3), ("z", 0)}
    assert {tuple(r) for r in graph.layers(edges, vertices.where("id = 'a'"), 2).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert graph.fiedler(edges, 25) == pytest.approx(1.0, abs=1e-3)  # a path of three
    assert graph.fiedler(edges.limit(0)) == 0


def test_isolation(spark):
    rows = [(f"s{i}", float(i % 10), 1.0) for i in range(200)] + [("odd", 500.0, -90.0), ("null", None, 1.0)]
    df = spark.createDataFrame(rows, "s string, x double, y double")
    got = {r.s: r.score for r in isolation_scores(df, "s", ["x", "y"]).collect()}
    assert max(got, key=got.get) == "odd" and got["odd"] > 0.6 > got["s5"]
    assert isolation_scores(df.limit(0), "s", ["x", "y"]).count() == 0


def test_routes_end(spark):
    events = spark.createDataFrame([("e", "a", "go", "1")], "id string, namespace string, event string, v string")
    rules = [{"from": "a", "event": "go", "to": "b", "when": "v == '1'", "template": "{{v}} {{w}}"}, {"from": "b", "event": "bridged", "to": "b", "when": "v != 2", "template": "again"}]
    assert sorted((r.namespace, r.depth, r.message) for r in route(events, rules, ["v"]).collect()) == [("b", 0, "1 {{w}}"), ("b", 1, "again"), ("b", 2, "again")]


def test_clock_is_fixed():
    assert S.AS_OF == dt.datetime(2026, 1, 1, tzinfo=dt.UTC)
