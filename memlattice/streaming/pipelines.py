"""Streams over arriving records: event-time windows, count-triggered batches a namespace, and routing by rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlattice.operators.filters import condition, template
from memlattice.streaming.entity_features import source
from memlattice.tables import subfolders


def drain(stream: DataFrame, home: str, mode: str, each: Callable[[DataFrame, int], None]) -> None:
    """Runs a stream over what is there, from where its checkpoint stands."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{home}/checkpoint").foreachBatch(each).trigger(availableNow=True).start()
    query.awaitTermination()


def windows(stream: DataFrame, home: str, width: str = "1 day", lateness: str = "30 days") -> DataFrame:
    """window_start, event_type, n, total of events (ts, event_type, value) by tumbling windows of event time. Rows
    later than the watermark are left out; nulls in value count as rows."""
    counted = (
        stream.withWatermark("ts", lateness)
        .groupBy(F.window("ts", width).alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
    )
    path = f"{home}/windows"
    drain(counted, home, "update", lambda df, epoch: df.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{path}/epoch={epoch}"))
    if not subfolders(stream.sparkSession, path):
        return stream.sparkSession.createDataFrame([], "window_start timestamp, event_type string, n bigint, total double")
    rows = stream.sparkSession.read.option("basePath", path).parquet(path)
    return rows.groupBy("window_start", "event_type").agg(F.max_by(F.struct("n", "total"), "epoch").alias("x")).select("window_start", "event_type", "x.*")


def counted_batches(stream: DataFrame, home: str, threshold: int = 10, fire: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """namespace, n_fired, n_pending: how often a consolidation is due when each namespace fires at `threshold` pending
    records and counts on with the rest. Each micro-batch adds its counts, pre-aggregated, to the last epoch's; an epoch
    that is run again reads the one before it. fire(namespaces, epoch), if given, is called after each batch with the
    namespaces that became due in it (namespace, times), and must bear being called twice for an epoch."""
    path = f"{home}/counters"

    def add(df: DataFrame, epoch: int) -> None:
        new = df.groupBy(F.coalesce("namespace", F.lit("default")).alias("namespace")).agg(F.count("*").alias("n")).withColumn("before", F.lit(0).cast("bigint"))
        if epoch > 0:
            old = df.sparkSession.read.parquet(f"{path}/{epoch - 1}")
            new = new.unionByName(old.select("namespace", "n", F.col("n").alias("before")))
        new.groupBy("namespace").agg(F.sum("n").alias("n"), F.sum("before").alias("before")).write.mode("overwrite").parquet(f"{path}/{epoch}")
        if fire is not None:
            counts = df.sparkSession.read.parquet(f"{path}/{epoch}")
            times = F.floor(F.col("n") / threshold) - F.floor(F.col("before") / threshold)
            fire(counts.select("namespace", times.alias("times")).where("times > 0"), epoch)

    drain(stream, home, "append", add)
    epochs = [int(p) for p in subfolders(stream.sparkSession, path)]
    if not epochs:
        return stream.sparkSession.createDataFrame([], "namespace string, n_fired bigint, n_pending bigint")
    n = stream.sparkSession.read.parquet(f"{path}/{max(epochs)}")
    return n.select("namespace", F.floor(F.col("n") / threshold).alias("n_fired"), (F.col("n") % threshold).alias("n_pending"))


def greatest_seen(stream: DataFrame, home: str, by: str, columns: list[str]) -> DataFrame:
    """`by` and the greatest value of each column so far, kept as streaming state; rows without `by` are left out."""
    kept = stream.where(F.col(by).isNotNull()).groupBy(by).agg(*[F.max(c).alias(c) for c in columns])
    path = f"{home}/greatest"
    drain(kept, home, "update", lambda df, epoch: df.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{path}/epoch={epoch}"))
    if not subfolders(stream.sparkSession, path):
        return stream.select(by, *columns).sparkSession.createDataFrame([], stream.select(by, *columns).schema)
    rows = stream.sparkSession.read.option("basePath", path).parquet(path)
    return rows.groupBy(by).agg(F.max_by(F.struct(*columns), "epoch").alias("x")).select(by, "x.*")


def triggered(events: DataFrame, routes: list[dict[str, str | list[str]]], tools: set[str]) -> DataFrame:
    """id, position, tool, status of the tools that arriving events (id, namespace, event) set off, in order. A route has
    event, namespace (none: every one) and tools; a tool that is not known is `skipped`, others are `due`."""
    known = [(r["event"], r.get("namespace"), list(r["tools"])) for r in routes]
    table = events.sparkSession.createDataFrame(known, "event string, route_namespace string, tools array<string>")  # a few rules
    hits = events.select("id", "namespace", "event").join(F.broadcast(table), "event").where("route_namespace is null or route_namespace = namespace")
    return hits.select("id", F.posexplode("tools").alias("position", "tool")).withColumn("status", F.when(F.col("tool").isin(*tools), "due").otherwise("skipped"))


def route(events: DataFrame, rules: list[dict[str, str]], fields: list[str], depth: int = 3) -> DataFrame:
    """id, namespace, depth, message: what the rules make of events, also of the events that they make, up to `depth`.

    events: id, namespace, event and the fields. A rule has from, event, to, when (a condition on a field) and template;
    what it makes is an event `bridged` in `to` with the same fields. Rules are few and become one pass a level.
    """
    found, level = None, events.select("id", "namespace", "event", *fields)
    for d in range(depth):
        made = [
            level.where((F.col("namespace") == r["from"]) & (F.col("event") == r["event"]) & condition(r["when"], fields)).select("id", F.lit(r["to"]).alias("namespace"), F.lit("bridged").alias("event"), *fields, template(r["template"], fields).alias("message"))
            for r in rules
        ]
        if not made:
            break
        step = made[0]
        for m in made[1:]:
            step = step.unionByName(m)
        out = step.select("id", "namespace", F.lit(d).alias("depth"), "message")
        found = out if found is None else found.unionByName(out)
        level = step.drop("message")
    return found if found is not None else events.select("id", "namespace", F.lit(0).alias("depth"), F.lit("").alias("message")).limit(0)


def events_stream(spark: SparkSession, path: str, bytes_per_batch: int = 16 * 2**30) -> DataFrame:
    df = source(spark, path, bytes_per_batch)
    return df.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in df.columns else df
