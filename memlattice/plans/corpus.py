"""Queries p3_ and p5_: feature rows of an event stream and orphan references, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlattice.operators.references import orphan_references, orphans_by_month
from memlattice.streaming.entity_features import feature_cells, feature_table, traces_features
from memlattice.tables import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = feature_cells(spark, traces_features(spark, f"{sf_dir}/retrieval_traces.parquet"))
    return cells.select(F.col("entity").alias("session_id"), F.col("type").alias("tool_used"), F.col("n").alias("n_calls"), F.col("n_flagged").alias("n_retries"), "last_ms")


def p3_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a session; its tools as JSON."""
    rows = feature_table(spark, traces_features(spark, f"{sf_dir}/retrieval_traces.parquet"))
    return rows.select(F.col("entity").alias("session_id"), F.col("n_events").alias("n_calls"), F.col("n_flagged").alias("n_retries"), "last_ms", F.col("n_types").alias("n_tools"), F.to_json("features").alias("tools"))


def thread_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    threads = table(spark, sf_dir, "threads")
    fields = ["related_memory_ids", "session_refs"]
    refs = threads.select(
        F.col("id").alias("owner_id"),
        F.coalesce("updated_at", "created_at").alias("seen_at"),
        F.explode(F.array(*[F.struct(F.lit(f).alias("ref_field"), F.col(f).alias("ref_values")) for f in fields])).alias("f"),
    ).select("owner_id", "seen_at", "f.ref_field", F.explode("f.ref_values").alias("ref_value"))
    memories = table(spark, sf_dir, "memories").select(F.lit(fields[0]).alias("ref_field"), F.col("id").alias("parent"), "created_at")
    sessions = table(spark, sf_dir, "ops").select(F.lit(fields[1]).alias("ref_field"), F.col("session_ref").alias("parent"), "created_at")
    field_of = F.when(F.col("collection") == "memories", fields[0]).when(F.col("collection") == "ops", fields[1])
    tombstones = table(spark, sf_dir, "tombstones").select(field_of.alias("ref_field"), F.col("record_id").alias("parent")).where("ref_field is not null")
    return orphan_references(refs, memories.unionByName(sessions), tombstones)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return thread_orphans(spark, sf_dir).select(F.col("owner_id").alias("thread_id"), "ref_field", "ref_value", "reason").distinct()


def p5_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans_by_month(thread_orphans(spark, sf_dir))


QUERIES = {"p3_found": p3_found, "p3_features": p3_features, "p5_found": p5_found, "p5_by_month": p5_by_month}

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160) || chr(12288)"
_CALLS = f"""
WITH latest AS (
  SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY ingested_at DESC) AS rn FROM retrieval_traces),
calls AS (
  SELECT coalesce(nullif(lower(trim(session_id, {_BLANKS})), ''), 'unknown') AS session_id,
         coalesce(nullif(lower(trim(tool_used, {_BLANKS})), ''), 'unknown') AS tool_used,
         coalesce(retry_within_60s, false) AS retried, coalesce(epoch_ms("timestamp"), -1) AS ms
  FROM latest WHERE rn = 1 OR trace_id IS NULL),
cells AS (
  SELECT session_id, tool_used, count(*) AS n_calls, count(*) FILTER (retried) AS n_retries, max(ms) AS last_ms
  FROM calls GROUP BY ALL)
"""
_REFS = f"""
WITH refs AS (
  SELECT id AS thread_id, coalesce(updated_at, created_at) AS seen_at, 'related_memory_ids' AS ref_field, unnest(related_memory_ids) AS raw FROM threads
  UNION ALL SELECT id, coalesce(updated_at, created_at), 'session_refs', unnest(session_refs) FROM threads),
asked AS (SELECT DISTINCT thread_id, seen_at, ref_field, lower(trim(raw, {_BLANKS})) AS ref_value FROM refs WHERE trim(raw, {_BLANKS}) <> ''),
live AS (
  SELECT 'related_memory_ids' AS ref_field, lower(trim(id, {_BLANKS})) AS k, min(created_at) AS first_at FROM memories GROUP BY ALL
  UNION ALL SELECT 'session_refs', lower(trim(session_ref, {_BLANKS})) AS k, min(created_at) FROM ops GROUP BY ALL),
dead AS (
  SELECT DISTINCT CASE collection WHEN 'memories' THEN 'related_memory_ids' WHEN 'ops' THEN 'session_refs' END AS ref_field,
         lower(trim(record_id, {_BLANKS})) AS k FROM tombstones),
orphans AS (
  SELECT a.*, CASE WHEN l.k IS NULL AND d.k IS NOT NULL THEN 'deleted' WHEN l.k IS NULL THEN 'missing'
                   WHEN l.first_at > a.seen_at THEN 'late' END AS reason
  FROM asked a LEFT JOIN live l ON l.ref_field = a.ref_field AND l.k = a.ref_value
  LEFT JOIN dead d ON d.ref_field = a.ref_field AND d.k = a.ref_value)
"""
ORACLE = {
    "p3_found": _CALLS + "SELECT * FROM cells",
    "p3_features": _CALLS
    + """SELECT session_id, sum(n_calls)::bigint AS n_calls, sum(n_retries)::bigint AS n_retries, max(last_ms) AS last_ms, count(*) AS n_tools,
  '[' || string_agg('{"type":' || to_json(tool_used) || ',"n":' || n_calls || ',"flagged":' || n_retries || ',"last":' || last_ms || '}', ',' ORDER BY tool_used) || ']' AS tools FROM cells GROUP BY session_id""",
    "p5_found": _REFS + "SELECT DISTINCT thread_id, ref_field, ref_value, reason FROM orphans WHERE reason IS NOT NULL",
    "p5_by_month": _REFS
    + """SELECT ref_field, strftime(seen_at, '%Y-%m') AS month, reason,
       count(DISTINCT (thread_id, ref_value)) AS n_references, count(DISTINCT thread_id) AS n_owners
FROM orphans WHERE reason IS NOT NULL GROUP BY ALL""",
}
