import datetime as dt

from memlattice.operators import updates as U

KIND = "id string, salience double, confidence double, access_count int, faded boolean, source_files array<string>, last_accessed timestamp, updated_at timestamp, fsrs struct<stability:double,difficulty:double,reps:int,lapses:int,state:string,last_review:timestamp>, n bigint"
T0 = dt.datetime(2025, 12, 1)


def memories(spark):
    f = (5.0, 5.0, 3, 0, "review", T0)
    rows = [("a", 0.5, 0.98, 1, False, ["x"], T0, T0, f, 7), ("b", 0.5, 0.5, 9, None, None, T0, T0, f, 7), ("c", 0.1, None, None, None, ["y", "x"], None, None, None, 7), (None, 0.2, 0.2, 2, None, None, None, None, None, 7)]
    return spark.createDataFrame(rows, KIND)


def test_touch_and_feedback(spark):
    m = memories(spark)
    got = {r.id: (r.access_count, r.n) for r in U.touch(m, spark.createDataFrame([("a",), ("a",), ("c",), ("zz",)], "id string")).collect()}
    assert got == {"a": (3, 7), "b": (9, 7), "c": (1, 7), None: (2, 7)}
    votes = spark.createDataFrame([("a", True), ("b", False), ("b", False), ("c", None)], "id string, helpful boolean")
    got = {r.id: round(r.confidence, 3) for r in U.feedback(m, votes).collect()}
    assert got == {"a": 1.0, "b": 0.3, "c": 0.4, None: 0.2}


def test_forget_and_validate(spark):
    m = memories(spark)
    got = {r.id: r for r in U.forget(m, spark.createDataFrame([("a",), ("a",)], "id string")).collect()}
    assert (got["a"].salience, got["a"].faded, got["a"].fsrs.state, got["a"].fsrs.lapses, got["a"].fsrs.reps) == (0.3, True, "relearning", 1, 4)
    assert got["b"].fsrs.lapses == 0 and got["c"].fsrs is None and len(got) == 4
    got = {r.id: r.fsrs for r in U.validate(m, spark.createDataFrame([("a", True), ("b", True), ("b", False)], "id string, outcome boolean")).collect()}
    assert (got["a"].state, got["a"].lapses, got["b"].state, got["b"].lapses) == ("review", 0, "relearning", 1) and got["a"].stability > 5


def test_merge_duplicates(spark):
    pairs = spark.createDataFrame([("a", "b", 0.9), ("a", "c", 0.95), ("b", "c", 0.91)], "id_a string, id_b string, similarity double")
    got = {r.id: (r.salience, r.faded, r.access_count, r.source_files) for r in U.merge_duplicates(memories(spark), pairs).collect()}
    assert got["a"] == (0.5, False, 9, ["x", "y"]) and got["b"][:2] == (0.0, True) and got["c"][:2] == (0.0, True) and got[None][0] == 0.2


def test_observed_effects(spark):
    obs = spark.createDataFrame([("p", 0.9), ("q", 0.9), ("r", 0.1), ("s", None)], "id string, salience double")
    gates = spark.createDataFrame([("p", "merge", 0.97, "m"), ("r", "link", 0.4, "n")], "query_id string, decision string, max_similarity double, nearest_id string")
    got = {r.id: (r.effect, r.memory_id, r.prediction_error, r.surprising) for r in U.observed(obs, gates).collect()}
    assert got == {"p": ("touch", "m", 0.03, False), "q": ("create", None, None, False), "r": ("keep", "n", 0.6, True), "s": ("keep", None, None, False)}


def test_feedback_in_order_and_in_chunks(spark):
    m = memories(spark)
    at = lambda h: T0 + dt.timedelta(hours=h)
    votes = [("a", True, at(1)), ("a", True, at(2)), ("a", False, at(30)), ("b", False, None), ("b", True, at(5)), ("zz", True, at(1))]
    df = spark.createDataFrame(votes, "id string, helpful boolean, at timestamp")
    got = {r.id: (round(r.confidence, 3), r.access_count) for r in U.feedback(m, df).where("id in ('a', 'b')").collect()}
    assert got["a"] == (0.9, 3) and got["b"] == (0.45, 10)  # 0.98, 1, 1, 0.9 and not 0.98 + 0.1 - 0.1
    many = [("a", i % 7 != 0, at(i)) for i in range(200)] + [("b", i % 3 == 0, at(i)) for i in range(200)]
    want = {"a": 0.98, "b": 0.5}
    for i, up, _ in many:
        want[i] = min(1.0, max(0.05, want[i] + (0.05 if up else -0.10)))
    df = spark.createDataFrame(many, "id string, helpful boolean, at timestamp")
    f = {r.id: r for r in U.folded(df, chunk_rows=3).collect()}
    start = {"a": 0.98, "b": 0.5}
    assert {i: round(min(r.high, max(r.low, start[i] + r.by)), 6) for i, r in f.items()} == {i: round(x, 6) for i, x in want.items()}
    log = {r.id: (r.n_votes, round(r.confidence_after, 6)) for r in U.feedback_log(m, df).collect()}
    assert log == {i: (200, round(want[i], 6)) for i in want}


def test_chains_of_duplicates_end_in_what_is_kept(spark):
    rows = [(i, s, None, n, False, [i], None, None, None, 0) for i, s, n in (("a", 0.9, 1), ("b", 0.8, 2), ("c", 0.7, 3), ("d", 0.6, 9), ("e", 0.5, 4))]
    pairs = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.9), ("c", "d", 0.9), ("a", "d", 0.86)], "id_a string, id_b string, similarity double")
    got = {r.id: (r.salience, r.faded, r.access_count, sorted(r.source_files)) for r in U.merge_duplicates(spark.createDataFrame(rows, KIND), pairs).collect()}
    assert got["a"] == (0.9, False, 9, ["a", "b", "c", "d"]) and got["e"] == (0.5, False, 4, ["e"])
    assert all(got[i][:2] == (0.0, True) for i in "bcd")


def test_believe_link_and_contradict(spark):
    kind = "id string, definition string, embedding array<float>, confidence double, updated_at timestamp"
    m = spark.createDataFrame([("a", "old", None, 0.9, T0), ("b", None, None, None, T0)], kind)
    revisions = spark.createDataFrame([("a", "new two", "r", None, T0 + dt.timedelta(1)), ("a", "new one", "r", None, T0), ("b", "first", "r", T0, None), ("zz", "x", "r", None, T0)], "id string, new_definition string, reason string, valid_from timestamp, at timestamp")
    rows, log = U.believe(m, revisions)
    assert {r.id: (r.definition, len(r.embedding)) for r in rows.collect()} == {"a": ("new two", 128), "b": ("first", 128)}
    assert sorted((r.concept_id, r.old_definition, r.new_definition) for r in log.collect()) == [("a", "new one", "new two"), ("a", "old", "new one"), ("b", None, "first")]
    edges = spark.createDataFrame([("a", "b", "extends")], "source_id string, target_id string, relation string")
    p = spark.createDataFrame([("a", "b", "extends", 0.5), ("a", "b", None, None), ("a", "b", "likes", 0.1), ("a", "zz", "extends", 9.0), (None, "b", None, None), ("zz", "b", "extends", None)], "source_id string, target_id string, relation string, weight double")
    got = {(r.source_id, r.target_id, r.relation): (r.weight, r.error) for r in U.linked(edges, p, m, ("extends", "related")).collect()}
    assert got[("a", "b", "extends")][1] == "there already" and got[("a", "b", "related")] == (0.7, None) and got[("a", "b", "likes")][1] == "no such relation"
    assert got[("a", "zz", "extends")] == (1.0, "no such target") and got[(None, "b", "related")][1] == "no ids" and got[("zz", "b", "extends")][1] == "no such source"
    v = spark.createDataFrame([("a", "genuine", 1.0), ("a", "genuine", None), ("a", "tension", 1.0), ("b", "genuine", 0.0)], "id string, verdict string, confidence double")
    assert {r.id: r.confidence and round(r.confidence, 3) for r in U.contradicted(m, v).collect()} == {"a": 0.675, "b": None}


def test_reconsidered(spark):
    m = spark.createDataFrame([("a", "old", 0.8, T0), ("b", "old", 0.2, T0), ("c", "old", 0.9, T0)], "id string, definition string, confidence double, updated_at timestamp")
    reviews = spark.createDataFrame([("a", "narrow", 0.9, " old "), ("b", None, 0.2, "new"), ("c", "mild", 0.01, None)], "id string, concern string, penalty double, revised_definition string")
    rows, signals = U.reconsidered(m, reviews)
    assert {r.id: (r.definition, round(r.confidence, 3), r.updated_at == T0) for r in rows.collect()} == {"a": ("old", 0.55, False), "b": ("new", 0.1, False), "c": ("old", 0.9, True)}
    assert {r.concept_id: round(r.priority, 3) for r in signals.collect()} == {"a": 0.8, "c": 0.34}
