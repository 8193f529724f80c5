import datetime as dt
import random

import pandas as pd

from memlattice.streaming.entity_features import feature_cells, feature_rows, run_features, source

COLUMNS = ["trace_id", "session_id", "tool_used", "retry_within_60s", "timestamp", "ingested_at"]
KIND = "trace_id string, session_id string, tool_used string, retry_within_60s boolean, timestamp timestamp, ingested_at timestamp, shard string"
T0 = dt.datetime(2025, 7, 1)


def traces(n, seed):
    draw = random.Random(seed)
    out = []
    for _ in range(n):
        i = draw.randrange(n // 2)
        fixed = random.Random(i)
        session = "hot" if i % 3 == 0 else fixed.choice([None, " ", "S1", "s1 ", "s2"])
        out.append((f"t{i}", session, fixed.choice(["Query", "query ", None, "", "dream"]), draw.random() < 0.5, fixed.choice([None, T0 + dt.timedelta(minutes=i)]), T0 + dt.timedelta(seconds=draw.randrange(10**6)), "clash"))
    return out


def expected(rows):
    df = pd.DataFrame(rows, columns=[*COLUMNS, "shard"]).sort_values("ingested_at").drop_duplicates("trace_id", keep="last")
    named = lambda s: s.fillna("").str.strip().str.lower().replace("", "unknown")
    df["e"], df["t"] = named(df.session_id), named(df.tool_used)
    df["ms"] = [-1 if pd.isna(x) else int(pd.Timestamp(x).timestamp() * 1000) for x in df.timestamp]
    g = df.groupby(["e", "t"]).agg(n=("e", "size"), f=("retry_within_60s", "sum"), ms=("ms", "max")).reset_index()
    return sorted(map(tuple, g.itertuples(index=False)))


def cells(spark, path):
    return sorted((r.entity, r.type, r.n, r.n_flagged, r.last_ms) for r in feature_cells(spark, path).collect())


def test_upserts_over_batches_equal_one_pass(spark, tmp_path):
    data, home = str(tmp_path / "in"), str(tmp_path / "home")
    first, second = traces(400, 1), traces(400, 2)
    spark.createDataFrame(first, KIND).repartition(4).write.parquet(data)
    path = run_features(source(spark, data, 1), home, shards=8, buckets=3)  # a file a batch
    assert cells(spark, path) == expected(first)
    spark.createDataFrame(second, KIND).repartition(2).write.mode("append").parquet(data)
    run_features(source(spark, data, 1), home, shards=8, buckets=3)  # goes on from the checkpoint
    assert cells(spark, path) == expected(first + second)
    totals = {r.entity: r.n_events for r in feature_rows(feature_cells(spark, path)).collect()}
    assert sum(totals.values()) == len({r[0] for r in first + second})


def test_event_that_moves_leaves_its_old_cell(spark, tmp_path):
    data, home = str(tmp_path / "in"), str(tmp_path / "home")
    early, late = T0, T0 + dt.timedelta(hours=1)
    spark.createDataFrame([("a", "s1", "x", True, T0, early, ""), (None, "s1", "x", None, T0, None, ""), (None, "s1", "x", None, T0, None, "")], KIND).coalesce(1).write.parquet(data)
    path = run_features(source(spark, data, 1), home, shards=2, buckets=2)
    assert cells(spark, path) == [("s1", "x", 2, 1, 1751328000000)]
    spark.createDataFrame([("a", "s2", "y", False, None, late, "")], KIND).coalesce(1).write.mode("append").parquet(data)
    run_features(source(spark, data, 1), home, shards=2, buckets=2)
    assert cells(spark, path) == [("s1", "x", 1, 0, 1751328000000), ("s2", "y", 1, 0, -1)]


def test_empty_table(spark, tmp_path):
    data = str(tmp_path / "in")
    spark.createDataFrame([], KIND).write.parquet(data)
    assert cells(spark, run_features(source(spark, data, 1), str(tmp_path / "home"))) == []


def test_the_latest_time_leaves_with_its_event(spark, tmp_path):
    data, home = str(tmp_path / "in"), str(tmp_path / "home")
    at = lambda h: T0 + dt.timedelta(hours=h)
    ms = lambda h: 1751328000000 + h * 3_600_000
    spark.createDataFrame([("a", "s1", "x", True, at(9), at(0), ""), ("b", "s1", "x", False, at(3), at(0), ""), ("c", "s1", "x", None, None, at(0), "")], KIND).coalesce(1).write.parquet(data)
    path = run_features(source(spark, data, 1), home, shards=2, buckets=2, pages=1)
    assert cells(spark, path) == [("s1", "x", 3, 1, ms(9))]
    spark.createDataFrame([("a", "s2", "x", True, at(9), at(2), ""), ("b", "s1", "x", True, at(3), at(1), ""), ("b", "s1", "x", False, at(8), at(0), "")], KIND).coalesce(1).write.mode("append").parquet(data)
    run_features(source(spark, data, 1), home, shards=2, buckets=2, pages=1)  # a late delivery of b changes nothing
    assert cells(spark, path) == [("s1", "x", 2, 1, ms(3)), ("s2", "x", 1, 1, ms(9))]
    spark.createDataFrame([("b", "s1", "x", True, None, at(5), "")], KIND).coalesce(1).write.mode("append").parquet(data)
    run_features(source(spark, data, 1), home, shards=2, buckets=2, pages=1)
    assert cells(spark, path) == [("s1", "x", 2, 1, -1), ("s2", "x", 1, 1, ms(9))]


def test_only_two_epochs_of_a_bucket_stay(spark, tmp_path):
    data, home = str(tmp_path / "in"), str(tmp_path / "home")
    spark.createDataFrame(traces(200, 3), KIND).repartition(6).write.parquet(data)
    path = run_features(source(spark, data, 1), home, shards=2, buckets=1, pages=3)
    assert cells(spark, path) == expected(traces(200, 3))
    run_features(source(spark, data, 1), home, shards=2, buckets=1, pages=3)  # nothing new
    assert len(list((tmp_path / "home" / "features" / "bucket=0").glob("epoch=*"))) <= 2
