"""The engine's records as DataFrames: current versions of the stored tables, and the graph, signals and revisions that
derive from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memlattice.operators.retrieval import gate, nearest_batch
from memlattice.tables import key, table

# Kinds of edges and categories of memories.
RELATIONS = ("extends", "refines", "contradicts", "tensions-with", "questions", "supports", "exemplifies", "caused", "related")
CATEGORIES = ("belief", "pattern", "entity", "topic", "value", "project", "insight", "observation", "goal")


def latest(df: DataFrame, id_column: str, *order: str) -> DataFrame:
    """One row an id, that with the greatest order columns (nulls are least); rows without an id leave. Each task keeps
    one row an id before the shuffle, and columns that aren't used later aren't read."""
    w = Window.partitionBy(id_column).orderBy(*[F.desc_nulls_last(c) for c in order])
    return df.where(F.col(id_column).isNotNull()).withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).drop("_n")


def memories(spark: SparkSession, d: str) -> DataFrame:
    return latest(table(spark, d, "memories"), "id", "updated_at", "access_count")


def observations(spark: SparkSession, d: str) -> DataFrame:
    return latest(table(spark, d, "observations"), "id", "updated_at")


def ops(spark: SparkSession, d: str) -> DataFrame:
    return latest(table(spark, d, "ops"), "id", "updated_at").withColumn("session", F.nullif(key("session_ref"), F.lit("")))


def threads(spark: SparkSession, d: str) -> DataFrame:
    return latest(table(spark, d, "threads"), "id", "updated_at")


def traces(spark: SparkSession, d: str) -> DataFrame:
    """Each trace's last delivery; session and tool in their normal form."""
    df = latest(table(spark, d, "retrieval_traces"), "trace_id", "ingested_at")
    named = lambda c: F.nullif(key(c), F.lit(""))
    return df.withColumns({"session": named("session_id"), "tool": F.coalesce(named("tool_used"), F.lit("unknown")), "retried": F.coalesce("retry_within_60s", F.lit(False))})


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges between memories that a thread names one after the other: id, source_id, target_id, relation, weight,
    created_at."""
    refs = threads(spark, d).select("id", "created_at", F.posexplode(F.transform("related_memory_ids", lambda x: key(x))).alias("pos", "source_id"))
    refs = refs.where(F.length("source_id") > 0)
    order = Window.partitionBy("id").orderBy("pos")
    pairs = refs.withColumn("target_id", F.lead("source_id").over(order)).where("target_id is not null and target_id <> source_id")
    known = memories(spark, d).select(F.lower("id").alias("k"))
    pairs = pairs.join(known.withColumnRenamed("k", "source_id"), "source_id", "left_semi").join(known.withColumnRenamed("k", "target_id"), "target_id", "left_semi")
    relation = F.element_at(F.array(*[F.lit(r) for r in RELATIONS]), (F.length("target_id") + F.ascii(F.substring("target_id", -1, 1)) + F.col("pos")) % 9 + 1)
    return pairs.select(F.concat_ws(":", "id", "pos").alias("id"), "source_id", "target_id", relation.alias("relation"), (F.lit(0.3) + F.col("pos") % 7 / 10).alias("weight"), "created_at")


def signals(spark: SparkSession, d: str) -> DataFrame:
    """Signals of surprising observations."""
    o = observations(spark, d).where("prediction_error >= 0.5")
    kind = F.when(F.col("prediction_error") >= 0.8, "CONTRADICTION").otherwise("SURPRISE")
    return o.select(F.concat(F.lit("sig-"), "id").alias("id"), kind.alias("type"), F.col("prediction_error").alias("priority"), F.coalesce("processed", F.lit(False)).alias("resolved"), "created_at", F.col("id").alias("observation_id"))


def signal_concepts(spark: SparkSession, d: str, kinds: DataFrame, *also: str) -> DataFrame:
    """id (of a signal), concept_id (lower case) of the given signals: the memory that the gate merges or links a
    signal's observation to. Signals of novel observations, and of those without a usable embedding, have none."""
    of = kinds.select(F.col("observation_id").alias("query_id"), F.col("id").alias("signal"))
    o = observations(spark, d).select(F.col("id").alias("query_id"), "embedding").join(of, "query_id", "left_semi")
    gated = gate(nearest_batch(o, memories(spark, d).select("id", "embedding"), 128, 5)).where("nearest_id is not null")
    return gated.join(of, "query_id").select(F.col("signal").alias("id"), F.lower("nearest_id").alias("concept_id"), *also)


def beliefs(spark: SparkSession, d: str) -> DataFrame:
    """The revisions of each thread's state, as written in its updates: concept_id, pos, changed_at, valid_from,
    new_definition, old_definition."""
    u = threads(spark, d).select(F.col("id").alias("concept_id"), F.posexplode("updates").alias("pos", "u"))
    u = u.select("concept_id", "pos", F.col("u.timestamp").alias("changed_at"), F.when(F.col("pos") % 3 != 2, F.col("u.timestamp")).alias("valid_from"), F.col("u.content").alias("new_definition"))
    return u.withColumn("old_definition", F.lag("new_definition").over(Window.partitionBy("concept_id").orderBy("changed_at", "pos")))


# The same in SQL. Each text is a common table expression.
SQL = {
    "mem": """mem AS (SELECT * FROM memories WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, access_count DESC NULLS LAST) = 1)""",
    "obs": """obs AS (SELECT * FROM observations WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST) = 1)""",
    "op": """op AS (SELECT *, nullif(lower(trim(session_ref)), '') AS session FROM ops WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST) = 1)""",
    "thr": """thr AS (SELECT * FROM threads WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST) = 1)""",
    "tr": """tr AS (SELECT *, nullif(lower(trim(session_id)), '') AS session, coalesce(nullif(lower(trim(tool_used)), ''), 'unknown') AS tool, coalesce(retry_within_60s, false) AS retried
  FROM retrieval_traces WHERE trace_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY ingested_at DESC NULLS LAST) = 1)""",
    "edg": """refs AS (SELECT id, created_at, generate_subscripts(related_memory_ids, 1) - 1 AS pos, lower(trim(unnest(related_memory_ids))) AS source_id FROM thr),
pairs AS (SELECT *, lead(source_id) OVER (PARTITION BY id ORDER BY pos) AS target_id FROM refs WHERE source_id <> ''),
edg AS (SELECT id || ':' || pos AS id, source_id, target_id,
  ['extends','refines','contradicts','tensions-with','questions','supports','exemplifies','caused','related'][((length(target_id) + ascii(right(target_id, 1)) + pos) % 9 + 1)::int] AS relation,
  0.3::double + (pos % 7) / 10::double AS weight, created_at
  FROM pairs WHERE target_id <> source_id AND source_id IN (SELECT lower(id) FROM mem) AND target_id IN (SELECT lower(id) FROM mem))""",
    "sig": """sig AS (SELECT 'sig-' || id AS id, CASE WHEN prediction_error >= 0.8 THEN 'CONTRADICTION' ELSE 'SURPRISE' END AS type, prediction_error AS priority,
  coalesce(processed, false) AS resolved, created_at, id AS observation_id FROM obs WHERE prediction_error >= 0.5)""",
    "bel": """upd AS (SELECT id AS concept_id, generate_subscripts(updates, 1) - 1 AS pos, unnest(updates) AS u FROM thr),
bel AS (SELECT concept_id, pos, u."timestamp" AS changed_at, CASE WHEN pos % 3 <> 2 THEN u."timestamp" END AS valid_from, u."content" AS new_definition,
  lag(u."content") OVER (PARTITION BY concept_id ORDER BY u."timestamp", pos) AS old_definition FROM upd)""",
}
NEEDS = {"edg": ["thr", "mem"], "sig": ["obs"], "bel": ["thr"]}


def with_sql(names: str, query: str) -> str:
    """The query after the common table expressions of the given names and of what these need."""
    order: list[str] = []
    for name in names.split():
        order += [n for n in [*NEEDS.get(name, []), name] if n not in order]
    return "WITH " + ",\n".join(SQL[n] for n in order) + "\n" + query
