import datetime as dt

from memlattice.streaming import pipelines as P

T0 = dt.datetime(2025, 7, 1)


def test_windows_over_batches(spark, tmp_path):
    data = str(tmp_path / "in")
    kind = "ts timestamp, event_type string, value double, epoch string"
    rows = [(T0 + dt.timedelta(hours=7 * i), "ab"[i % 2], None if i % 5 == 0 else float(i), "x") for i in range(40)]
    spark.createDataFrame(rows, kind).repartition(4).write.parquet(data)
    got = {(r.window_start, r.event_type): (r.n, r.total) for r in P.windows(P.events_stream(spark, data, 1), str(tmp_path / "home")).collect()}
    want = {}
    for t, e, v, _ in rows:
        n, s = want.get((day := t.replace(hour=0), e), (0, None))
        want[day, e] = (n + 1, s if v is None else (s or 0) + v)
    assert got == want


def test_counters_over_batches_and_restarts(spark, tmp_path):
    data, home = str(tmp_path / "in"), str(tmp_path / "home")
    frame = lambda n: spark.createDataFrame([("x" if i % 3 else None, i) for i in range(n)], "namespace string, n int")
    frame(33).repartition(3).write.parquet(data)
    read = lambda: {r.namespace: (r.n_fired, r.n_pending) for r in P.counted_batches(P.events_stream(spark, data, 1), home).collect()}
    assert read() == {"x": (2, 2), "default": (1, 1)}
    frame(9).write.mode("append").parquet(data)
    assert read() == {"x": (2, 8), "default": (1, 4)}


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "ts timestamp, event_type string, value double").write.parquet(str(tmp_path / "a"))
    spark.createDataFrame([], "namespace string").write.parquet(str(tmp_path / "b"))
    assert P.windows(P.events_stream(spark, str(tmp_path / "a")), str(tmp_path / "ha")).count() == 0
    assert P.counted_batches(P.events_stream(spark, str(tmp_path / "b")), str(tmp_path / "hb")).count() == 0


def test_due_namespaces_fire_once(spark, tmp_path):
    data, home, fired = str(tmp_path / "in"), str(tmp_path / "home"), {}
    spark.createDataFrame([("x" if i % 3 else None, i) for i in range(60)], "namespace string, n int").repartition(3).write.parquet(data)

    def fire(due, epoch):
        fired[epoch] = {r.namespace: r.times for r in due.collect()}

    P.counted_batches(P.events_stream(spark, data, 1), home, 10, fire)
    total = {n: sum(f.get(n, 0) for f in fired.values()) for n in ("x", "default")}
    assert total == {"x": 4, "default": 2} and len(fired) == 3


def test_greatest_values_over_batches(spark, tmp_path):
    data, home = str(tmp_path / "in"), str(tmp_path / "home")
    spark.createDataFrame([(f"m{i % 4}" if i % 9 else None, i, T0) for i in range(40)], "id string, n int, epoch timestamp").repartition(3).write.parquet(data)
    got = {r.id: r.n for r in P.greatest_seen(P.events_stream(spark, data, 1), home, "id", ["n"]).collect()}
    assert got == {"m0": 32, "m1": 37, "m2": 38, "m3": 39}


def test_triggers(spark):
    events = spark.createDataFrame([("e", "a", "go"), ("f", None, "go"), ("g", "a", "stop")], "id string, namespace string, event string")
    routes = [{"event": "go", "namespace": "a", "tools": ["x", "y"]}, {"event": "go", "tools": ["z"]}]
    got = sorted((r.id, r.position, r.tool, r.status) for r in P.triggered(events, routes, {"x", "z"}).collect())
    assert got == [("e", 0, "x", "due"), ("e", 0, "z", "due"), ("e", 1, "y", "skipped"), ("f", 0, "z", "due")]
