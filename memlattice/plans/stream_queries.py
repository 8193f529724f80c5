"""Queries that run as streams, over everything that has arrived."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlattice.plans import model as M
from memlattice.streaming import pipelines
from memlattice.tables import shared_dir

RULES = [
    {"from": "log", "event": "done", "to": "review", "when": "status == 'done'", "template": "{{project}}: {{content}}"},
    {"from": "review", "event": "bridged", "to": "archive", "when": "project == 'hask-bridge'", "template": "archived {{project}}"},
]


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each day and type, by a windowed stream."""
    return pipelines.windows(pipelines.events_stream(spark, f"{sf_dir}/events.parquet"), shared_dir(spark)).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd"))


def stream_consolidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each namespace's counter fires over the arriving memories."""
    return pipelines.counted_batches(pipelines.events_stream(spark, f"{sf_dir}/memories.parquet"), shared_dir(spark))


def bridge_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished log entries, bridged on by rules."""
    events = M.ops(spark, sf_dir).where("project is not null").select("id", F.col("type").alias("namespace"), F.col("status").alias("event"), "project", "status", "content")
    return pipelines.route(events, RULES, ["project", "status", "content"])


def access_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accesses and last access of each memory, from versions as they arrive."""
    return pipelines.greatest_seen(pipelines.events_stream(spark, f"{sf_dir}/memories.parquet"), shared_dir(spark), "id", ["access_count", "last_accessed"])


TRIGGERS = [{"event": "open", "namespace": "log", "tools": ["observe", "tag"]}, {"event": "done", "tools": ["digest"]}]


def ingestion_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tools that entries of the operations log set off."""
    events = M.ops(spark, sf_dir).select("id", F.col("type").alias("namespace"), F.col("status").alias("event"))
    return pipelines.triggered(events, TRIGGERS, {"observe", "digest"}).withColumn("position", F.col("position").cast("bigint"))


QUERIES = {f.__name__: f for f in (stream_windows, stream_consolidation, bridge_routing, access_counters, ingestion_triggers)}
ORACLE = {
    "stream_windows": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS window_start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL",
    "stream_consolidation": "SELECT coalesce(namespace, 'default') AS namespace, count(*) // 10 AS n_fired, count(*) % 10 AS n_pending FROM memories GROUP BY ALL",
    "bridge_routing": M.with_sql(
        "op",
        """, a AS (SELECT * FROM op WHERE project IS NOT NULL AND type = 'log' AND status = 'done')
SELECT id, 'review' AS namespace, 0 AS depth, project || ': ' || coalesce(content, '{{content}}') AS message FROM a UNION ALL SELECT id, 'archive', 1, 'archived ' || project FROM a WHERE project = 'hask-bridge'""",
    ),
    "ingestion_triggers": M.with_sql(
        "op",
        """SELECT id, unnest([0, 1]) AS position, unnest(['observe', 'tag']) AS tool, unnest(['due', 'skipped']) AS status FROM op WHERE type = 'log' AND status = 'open' UNION ALL SELECT id, 0, 'digest', 'due' FROM op WHERE status = 'done'""",
    ),
    "access_counters": "SELECT id, max(access_count) AS access_count, max(last_accessed) AS last_accessed FROM memories WHERE id IS NOT NULL GROUP BY id",
}
