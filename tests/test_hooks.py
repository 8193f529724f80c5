import datetime as dt
import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from memlattice.functions import hooks
from memlattice.functions import text as T
from memlattice.operators import walks
from memlattice.operators.sequences import previous


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def by_hand(text, dim=128):
    v = np.zeros(dim)
    for t in re.findall(r"[a-z0-9_]{2,}", text.lower()):
        h = hashlib.md5(t.encode()).hexdigest()
        v[int(h[:8], 16) % dim] += 1 if int(h[8:16], 16) % 2 == 0 else -1
    n = np.linalg.norm(v)
    return v / n if n else v


@pytest.mark.parametrize("text", ["The harbour ledger, the ferry", "", "same same same"])
def test_hashed_embedding(spark, text):
    assert one(spark, hooks.hashed_embedding(F.lit(text))) == pytest.approx(by_hand(text), abs=1e-6)


def test_expanded_query_falls_back(spark):
    embed = lambda c: F.array(F.length(c).cast("float"))
    for answer, want in ((None, 3.0), ("  ", 3.0), ("longer answer", 13.0)):
        assert one(spark, hooks.expanded_query(F.lit("abc"), lambda c, a=answer: F.lit(a).cast("string"), embed)) == [want]
    assert one(spark, hooks.expanded_query(F.lit("abc"), hooks.no_answer, embed)) == [3.0]


def test_adjudication(spark):
    rows = [("the ferry closes early", "the ferry does not closes early", "genuine"), ("ledger of the harbour ferry", "harbour ferry ledger", "complementary"), ("ferry harbour", "ferry ledger", "tension")]
    got = hooks.adjudicated(spark.createDataFrame([r[:2] for r in rows], "claim string, target string")).collect()
    assert [r.verdict for r in got] == [r[2] for r in rows]


def test_front_matter_phrases_and_json(spark):
    text = "---\nsalience: 8\nStatus: active\nstatus: 'archived'\nnote:\n---\nBody Text\n"
    assert one(spark, T.front_matter(F.lit(text))) == {"salience": "8", "status": "archived"}
    assert one(spark, T.body(F.lit(text))) == "Body Text\n" and one(spark, T.front_matter(F.lit("no block"))) == {}
    assert one(spark, T.phrases(F.lit("# Alpha beta, Gamma! x"))) == ["Alpha", "Alpha beta", "beta Gamma", "Gamma", "Gamma x"]
    assert one(spark, T.phrases(F.lit(None).cast("string"))) == [] and one(spark, T.phrases(F.lit("Word"))) == ["Word"]
    assert one(spark, T.json_array(F.lit('so: [{"a": 1}] done'))) == '[{"a": 1}]' and one(spark, T.json_array(F.lit("[broken"))) is None


def test_previous_over_days_equals_one_window(spark):
    t0 = dt.datetime(2025, 7, 1)
    rows = [("hot" if i % 3 else f"s{i % 7}", t0 + dt.timedelta(hours=5 * i), f"t{i:03}", None if i % 11 == 0 else f"q{i}") for i in range(120)]
    df = spark.createDataFrame(rows, "session string, at timestamp, id string, q string").withColumn("day", F.to_date("at"))
    got = {r.id: r.before for r in previous(df, ["session"], "day", ["at", "id"], "q", "before").collect()}
    want, last = {}, {}
    for s, _, i, q in sorted(rows, key=lambda r: (r[1], r[2])):
        want[i] = last.get(s)
        last[s] = q
    assert got == want


def test_walks_do_not_return(spark):
    scores = spark.createDataFrame([(f"m{i}", i / 10) for i in range(12)] + [("n", None)], "id string, score double")
    edges = spark.createDataFrame([(f"e{i}-{j}", f"m{i}", f"m{j}", 0.5) for i in range(12) for j in ((i + 1) % 12, (i + 5) % 12, i)], "id string, source_id string, target_id string, weight double")
    rows = walks.walks(scores, edges, walkers=6, steps=4).collect()
    by = {}
    for r in sorted(rows, key=lambda r: (r.walk, r.step)):
        by.setdefault(r.walk, []).append(r.id)
    assert len(by) == 6 and all(len(v) == len(set(v)) == 5 for v in by.values())
    pairs = {(r.source_id, r.target_id) for r in edges.collect()}
    assert all(p in pairs for v in by.values() for p in zip(v, v[1:], strict=False))


def test_weighted_pick_follows_the_weights(spark):
    rows = spark.createDataFrame([(g, i, w) for g in range(400) for i, w in (("a", 1.0), ("b", 3.0), ("c", 0.0))], "g int, i string, w double")
    got = walks.weighted_pick(rows, ["g"], "w", ["i"], walks.drawn(F.col("g"))).groupBy("i").count().collect()
    n = {r.i: r["count"] for r in got}
    assert sum(n.values()) == 400 and 250 < n["b"] < 350 and "c" not in n
