"""Queries over the engine's records, part one: scans, predicates, aggregations, windows, scores and texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memlattice.functions import scoring as S
from memlattice.functions import text as T
from memlattice.operators import filters, graph, updates
from memlattice.operators.forest import isolation_scores
from memlattice.operators.retrieval import top_k
from memlattice.operators.sequences import previous
from memlattice.plans import model as M
from memlattice.plans.model import with_sql
from memlattice.tables import key, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
NOW = "TIMESTAMPTZ '2026-01-01 00:00:00+00'"


def query(ctes: str = "", sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = with_sql(ctes, sql) if ctes else sql
        return f

    return register


def before(days: float):
    return S.now() - F.expr(f"interval {int(days * 86400)} seconds")


# Scans


@query("mem", f"SELECT id, name, updated_at, faded FROM mem WHERE updated_at >= {NOW} - INTERVAL 7 DAY ORDER BY updated_at DESC, id LIMIT 100")
def recent_memories(spark, d):
    return M.memories(spark, d).where(F.col("updated_at") >= before(7)).select("id", "name", "updated_at", "faded").orderBy(F.desc("updated_at"), "id").limit(100)


@query("obs", "SELECT id, content, created_at FROM obs WHERE NOT processed ORDER BY created_at, id LIMIT 50")
def unprocessed_observations(spark, d):
    return M.observations(spark, d).where(~F.col("processed")).select("id", "content", "created_at").orderBy("created_at", "id").limit(50)


@query(
    "op",
    f"""SELECT id, type, status, project, created_at FROM op WHERE type = 'log' AND status <> 'archived' AND created_at >= {NOW} - INTERVAL 60 DAY
  AND (contains(lower(content), 'map') OR len(list_filter(keywords, lambda k: contains(lower(k), 'map'))) > 0)""",
)
def ops_query(spark, d):
    filters_ = filters.ops_filter(kind="log", not_status="archived", keyword="map", since=before(60))
    return M.ops(spark, d).where(filters_).select("id", "type", "status", "project", "created_at")


@query("sig", "SELECT id, type, priority, created_at FROM sig WHERE NOT resolved ORDER BY priority DESC, created_at DESC, id LIMIT 20")
def open_signals(spark, d):
    return M.signals(spark, d).where(~F.col("resolved")).select("id", "type", "priority", "created_at").orderBy(F.desc("priority"), F.desc("created_at"), "id").limit(20)


@query("thr", "SELECT id, status, priority FROM thr WHERE status = 'open' AND priority >= 0.5 AND kind IS NOT NULL ORDER BY priority DESC NULLS LAST, id LIMIT 50")
def generic_filter_compare(spark, d):
    rules = [("status", "==", "open"), ("priority", ">=", 0.5), ("kind", "!=", None)]
    return filters.generic_query(M.threads(spark, d), rules, order="priority", descending=True, limit=50).select("id", "status", "priority")


@query("mem", "SELECT id, category, tags FROM mem WHERE category IN ('belief', 'goal') AND list_contains(tags, (SELECT min(t) FROM (SELECT unnest(tags) AS t FROM mem)))")
def generic_filter_in_contains(spark, d):
    memories = M.memories(spark, d)
    least = memories.select(F.explode("tags").alias("t")).agg(F.min("t").alias("t"))
    found = filters.generic_query(memories, [("category", "in", ["belief", "goal"])])
    return found.crossJoin(F.broadcast(least)).where(F.array_contains("tags", F.col("t"))).select("id", "category", "tags")  # one row


@query("mem", "SELECT id, last_retrieval_score FROM mem ORDER BY last_retrieval_score ASC NULLS LAST, id LIMIT 40")
def generic_nulls_last(spark, d):
    return filters.generic_query(M.memories(spark, d), [], order="last_retrieval_score", limit=40).select("id", "last_retrieval_score")


@query("mem", "SELECT id, name, category FROM mem ORDER BY id LIMIT 30 OFFSET 20")
def memories_page(spark, d):
    return M.memories(spark, d).select("id", "name", "category").orderBy("id").offset(20).limit(30)


@query("mem", "SELECT category, count(*) AS n FROM mem WHERE category IS NOT NULL GROUP BY category")
def category_counts(spark, d):
    return M.memories(spark, d).where("category is not null").groupBy("category").agg(F.count("*").alias("n"))


@query("mem edg", "SELECT DISTINCT e.id, e.source_id, e.target_id FROM edg e WHERE e.source_id IN (SELECT lower(id) FROM mem WHERE category = 'goal') OR e.target_id IN (SELECT lower(id) FROM mem WHERE category = 'goal')")
def edges_of_memories(spark, d):
    """Edges that touch a goal at either end."""
    goals = M.memories(spark, d).where("category = 'goal'").select(F.lower("id").alias("goal"))
    edges = M.edges(spark, d).select("id", "source_id", "target_id")
    ends = edges.select("id", F.explode(F.array("source_id", "target_id")).alias("goal")).join(goals, "goal", "left_semi").select("id").distinct()
    return edges.join(ends, "id", "left_semi")


@query("", "SELECT collection, count(DISTINCT lower(trim(record_id))) AS n FROM tombstones GROUP BY collection")
def deletions(spark, d):
    return table(spark, d, "tombstones").groupBy("collection").agg(F.count_distinct(key("record_id")).alias("n"))


@query("", "SELECT id, max(access_count) AS access_count, max(updated_at) AS updated_at FROM memories GROUP BY id")
def upsert(spark, d):
    """Early versions, overwritten by id with later ones."""
    rows = table(spark, d, "memories")
    first = M.latest(rows.withColumn("age", -F.unix_micros("updated_at")), "id", "age").drop("age")
    merged = filters.upsert(first, M.memories(spark, d), "id")
    best = rows.groupBy("id").agg(F.max("access_count").alias("access_count"))
    return merged.select("id", "updated_at").join(best, "id").select("id", "access_count", "updated_at")


@query("mem", "SELECT 'memories' AS kind, (SELECT count(*) FROM mem) AS n_left, (SELECT count(*) FROM mem WHERE NOT coalesce(faded, false)) AS n_right, (SELECT count(*) FROM mem WHERE coalesce(faded, false)) AS only_left, 0 AS only_right")
def verify_diff(spark, d):
    """The difference of two stores, compared row by row: all memories, and those that have not faded."""
    m = M.memories(spark, d).select("id", "name", "definition", "updated_at", "faded")
    return filters.diff(m, m.where(~F.coalesce("faded", F.lit(False))), "memories")


@query("bel", "SELECT concept_id, pos, changed_at, old_definition, new_definition FROM bel")
def belief_history(spark, d):
    return M.beliefs(spark, d).select("concept_id", "pos", "changed_at", "old_definition", "new_definition")


@query(
    "bel",
    f"""SELECT concept_id, new_definition, valid_from, valid_to FROM (
  SELECT *, lead(valid_from) OVER (PARTITION BY concept_id ORDER BY changed_at, pos) AS valid_to FROM bel WHERE valid_from IS NOT NULL)
WHERE valid_from <= {NOW} - INTERVAL 40 DAY AND (valid_to IS NULL OR valid_to > {NOW} - INTERVAL 40 DAY)""",
)
def belief_as_of(spark, d):
    """What was valid 40 days ago. Revisions of unknown validity close no interval."""
    known = M.beliefs(spark, d).where("valid_from is not null")
    known = known.withColumn("valid_to", F.lead("valid_from").over(Window.partitionBy("concept_id").orderBy("changed_at", "pos")))
    at = before(40)
    return known.where((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at))).select("concept_id", "new_definition", "valid_from", "valid_to")


@query("obs", f"SELECT id, created_at, salience FROM obs WHERE created_at >= {NOW} - INTERVAL 7 DAY AND coalesce(content_type, 'declarative') = 'declarative' ORDER BY created_at DESC, id LIMIT 25")
def recall(spark, d):
    o = M.observations(spark, d).where((F.col("created_at") >= before(7)) & (F.coalesce("content_type", F.lit("declarative")) == "declarative"))
    return o.select("id", "created_at", "salience").orderBy(F.desc("created_at"), "id").limit(25)


@query("thr", "SELECT * FROM (SELECT id, title, kind, priority FROM thr WHERE status = 'open' ORDER BY priority DESC NULLS LAST, id LIMIT 20) WHERE kind = 'research' OR kind IS NOT NULL")
def threads_list(spark, d):
    """The kind is filtered after the limit."""
    t = M.threads(spark, d).where("status = 'open'").select("id", "title", "kind", "priority").orderBy(F.desc_nulls_last("priority"), "id").limit(20)
    return t.where("kind is not null")


@query("op", "SELECT id, project || ': ' || coalesce(status, '{{status}}') AS message FROM op WHERE project IS NOT NULL AND status = 'done'")
def bridge_condition(spark, d):
    """A rule's condition text and template."""
    o = M.ops(spark, d).where(filters.condition("status == 'done'", ["status", "project"])).where("project is not null")
    return o.select("id", filters.template("{{project}}: {{status}}", ["project", "status"]).alias("message"))


# Aggregations


@query(
    "mem obs",
    f"""SELECT count(*) AS n_memories, avg(salience) AS avg_salience, count(*) FILTER (salience < 0.1) AS n_weak, count(*) FILTER (last_accessed < {NOW} - INTERVAL 90 DAY) AS n_stale,
  count(*) FILTER (fsrs.state = 'review') AS n_review, count(*) FILTER (fsrs.state = 'relearning') AS n_relearning,
  (SELECT count(*) FROM obs) AS n_observations, (SELECT count(*) FROM obs WHERE NOT processed) AS n_unprocessed, (SELECT avg(prediction_error) FROM obs) AS avg_error FROM mem""",
)
def health_summary(spark, d):
    count_if = lambda c: F.count_if(c)
    m = M.memories(spark, d).agg(
        F.count("*").alias("n_memories"), F.avg("salience").alias("avg_salience"), count_if(F.col("salience") < 0.1).alias("n_weak"),
        count_if(F.col("last_accessed") < before(90)).alias("n_stale"), count_if(F.col("fsrs.state") == "review").alias("n_review"), count_if(F.col("fsrs.state") == "relearning").alias("n_relearning"),
    )
    o = M.observations(spark, d).agg(F.count("*").alias("n_observations"), count_if(~F.col("processed")).alias("n_unprocessed"), F.avg("prediction_error").alias("avg_error"))
    return m.crossJoin(o)  # one row each


@query("mem", "SELECT coalesce(category, '(none)') AS category, coalesce(fsrs.state, '(none)') AS state, count(*) AS n, count(*) FILTER (faded) AS n_faded, avg(salience) AS avg_salience FROM mem GROUP BY ALL")
def report_memory(spark, d):
    m = M.memories(spark, d).groupBy(F.coalesce("category", F.lit("(none)")).alias("category"), F.coalesce("fsrs.state", F.lit("(none)")).alias("state"))
    return m.agg(F.count("*").alias("n"), F.count_if("faded").alias("n_faded"), F.avg("salience").alias("avg_salience"))


@query("obs", "SELECT coalesce(content_type, 'declarative') AS content_type, count(*) AS n, count(*) FILTER (NOT processed) AS n_unprocessed, count(prediction_error) / count(*)::double AS error_coverage FROM obs GROUP BY ALL")
def report_observations(spark, d):
    o = M.observations(spark, d).groupBy(F.coalesce("content_type", F.lit("declarative")).alias("content_type"))
    return o.agg(F.count("*").alias("n"), F.count_if(~F.col("processed")).alias("n_unprocessed"), (F.count("prediction_error") / F.count("*")).alias("error_coverage"))


@query(
    "mem edg",
    """SELECT (SELECT count(*) FROM mem) AS n, (SELECT count(*) FROM edg) AS n_edges, (SELECT count(*) FROM edg) / (SELECT count(*) * (count(*) - 1) / 2::double FROM mem) AS density,
  (SELECT count(*) FROM mem) - (SELECT count(DISTINCT v) FROM (SELECT source_id AS v FROM edg UNION ALL SELECT target_id FROM edg)) AS n_isolated""",
)
def report_graph(spark, d):
    edges = M.edges(spark, d)
    e = edges.select("id", F.explode(F.array("source_id", "target_id")).alias("v")).agg(F.count_distinct("id").alias("n_edges"), F.count_distinct("v").alias("n_ends"))
    n = M.memories(spark, d).agg(F.count("*").alias("n"))
    return n.crossJoin(e).select("n", "n_edges", (F.col("n_edges") / (F.col("n") * (F.col("n") - 1) / 2)).alias("density"), (F.col("n") - F.col("n_ends")).alias("n_isolated"))  # one row each


@query("mem edg", "SELECT relation, count(*) AS n, avg(weight) AS avg_weight FROM edg GROUP BY relation")
def report_relations(spark, d):
    return M.edges(spark, d).groupBy("relation").agg(F.count("*").alias("n"), F.avg("weight").alias("avg_weight"))


@query("op", "SELECT coalesce(project, '(none)') AS project, count(*) AS n, count(DISTINCT session) AS n_sessions, count(*) FILTER (regexp_matches(lower(content), 'error|failed')) AS n_flagged FROM op GROUP BY ALL")
def report_ops(spark, d):
    o = M.ops(spark, d).groupBy(F.coalesce("project", F.lit("(none)")).alias("project"))
    return o.agg(F.count("*").alias("n"), F.count_distinct("session").alias("n_sessions"), F.count_if(T.contains_any("content", ("error", "failed"))).alias("n_flagged"))


@query("thr", f"SELECT count(*) FILTER (status IN ('open', 'active')) AS n_open, count(*) FILTER (resolved_at >= {NOW} - INTERVAL 30 DAY) AS n_resolved, count(*) FILTER (blocked_by IS NOT NULL) AS n_blocked FROM thr")
def report_threads(spark, d):
    return M.threads(spark, d).agg(F.count_if(F.col("status").isin("open", "active")).alias("n_open"), F.count_if(F.col("resolved_at") >= before(30)).alias("n_resolved"), F.count_if(F.col("blocked_by").isNotNull()).alias("n_blocked"))


@query("mem edg", "SELECT m.id, count(v) AS degree FROM (SELECT lower(id) AS id FROM mem) m LEFT JOIN (SELECT source_id AS v FROM edg UNION ALL SELECT target_id FROM edg) e ON e.v = m.id GROUP BY m.id")
def graph_degree(spark, d):
    return graph.degrees(M.memories(spark, d).select(F.lower("id").alias("id")), M.edges(spark, d))


@query(
    "mem edg",
    """, g AS (SELECT m.id, m.category, count(v) AS degree FROM (SELECT lower(id) AS id, category FROM mem) m LEFT JOIN (SELECT source_id AS v FROM edg UNION ALL SELECT target_id FROM edg) e ON e.v = m.id GROUP BY ALL)
SELECT * FROM (SELECT 'most' AS kind, id, category, degree FROM g ORDER BY degree DESC, id LIMIT 5) UNION ALL SELECT * FROM (SELECT 'least' AS kind, id, category, degree FROM g ORDER BY degree, id LIMIT 5)
UNION ALL SELECT * FROM (SELECT 'orphan' AS kind, id, category, degree FROM g WHERE degree = 0 ORDER BY id LIMIT 10)""",
)
def graph_report(spark, d):
    """The five most and least connected memories, and the first ten that have no edge."""
    v = M.memories(spark, d).select(F.lower("id").alias("id"), "category")
    g = graph.degrees(v, M.edges(spark, d)).join(v, "id").select("id", "category", "degree")
    part = lambda kind, rows, n: rows.limit(n).select(F.lit(kind).alias("kind"), "*")
    return part("most", g.orderBy(F.desc("degree"), "id"), 5).unionByName(part("least", g.orderBy("degree", "id"), 5)).unionByName(part("orphan", g.where("degree = 0").orderBy("id"), 10))


@query("mem edg", "SELECT id FROM (SELECT lower(id) AS id FROM mem) WHERE id NOT IN (SELECT source_id FROM edg UNION SELECT target_id FROM edg)")
def orphans(spark, d):
    e = M.edges(spark, d)
    return M.memories(spark, d).select(F.lower("id").alias("id")).join(e.select(F.explode(F.array("source_id", "target_id")).alias("id")), "id", "left_anti")


@query("mem edg", "SELECT (SELECT count(DISTINCT v) FROM (SELECT source_id AS v FROM edg UNION ALL SELECT target_id FROM edg)) / count(*)::double AS coherence FROM mem")
def coherence(spark, d):
    deg = graph.degrees(M.memories(spark, d).select(F.lower("id").alias("id")), M.edges(spark, d))
    return deg.agg(F.coalesce(F.count_if(F.col("degree") > 0) / F.count("*"), F.lit(1.0)).alias("coherence"))


@query("tr", "SELECT tool, count(*) AS n, count(*) FILTER (retried) AS n_retries, floor(count(*) FILTER (retried) / count(*)::double * 100 + 0.5) AS retry_percent, count(*) FILTER (result_referenced) AS n_referenced FROM tr GROUP BY tool")
def audit_tools(spark, d):
    t = M.traces(spark, d).groupBy("tool").agg(F.count("*").alias("n"), F.count_if("retried").alias("n_retries"), F.count_if("result_referenced").alias("n_referenced"))
    return t.withColumn("retry_percent", F.floor(F.col("n_retries") / F.col("n") * 100 + 0.5).cast("double"))


@query("tr", "SELECT tool, coalesce(retry_tool, 'unknown') AS retry_tool, count(*) AS n FROM tr WHERE retried GROUP BY ALL")
def audit_flows(spark, d):
    return M.traces(spark, d).where("retried").groupBy("tool", F.coalesce("retry_tool", F.lit("unknown")).alias("retry_tool")).agg(F.count("*").alias("n"))


@query("tr", "SELECT heuristic_rule_fired AS rule, count(*) AS n, count(*) FILTER (NOT retried) / count(*)::double AS accuracy FROM tr WHERE heuristic_rule_fired IS NOT NULL GROUP BY ALL")
def audit_rules(spark, d):
    t = M.traces(spark, d).where("heuristic_rule_fired is not null").groupBy(F.col("heuristic_rule_fired").alias("rule"))
    return t.agg(F.count("*").alias("n"), (F.count_if(~F.col("retried")) / F.count("*")).alias("accuracy"))


# The detected intent that corresponds to a classifier's.
INTENTS = {"recalling-specific": "operational", "exploring-related": "exploratory", "finding-tension": "signal-surfacing", "mapping-structure": "graph-exploration", "resuming": "operational", "seeking-novelty": "exploratory", "ambiguous": "ambiguous"}


@query(
    "tr",
    """SELECT ml_intent, count(*) AS n, avg(ml_confidence) AS avg_confidence, count(*) FILTER (retried) AS n_retries,
  count(*) FILTER (coalesce(detected_intent, 'ambiguous') = CASE ml_intent WHEN 'recalling-specific' THEN 'operational' WHEN 'exploring-related' THEN 'exploratory' WHEN 'finding-tension' THEN 'signal-surfacing'
    WHEN 'mapping-structure' THEN 'graph-exploration' WHEN 'resuming' THEN 'operational' WHEN 'seeking-novelty' THEN 'exploratory' ELSE 'ambiguous' END) AS n_agree
FROM tr WHERE ml_intent IS NOT NULL GROUP BY ml_intent""",
)
def audit_intents(spark, d):
    mapped = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in INTENTS.items() for x in p]), F.col("ml_intent")), F.lit("ambiguous"))
    t = M.traces(spark, d).where("ml_intent is not null").withColumn("agree", mapped == F.coalesce("detected_intent", F.lit("ambiguous")))
    return t.groupBy("ml_intent").agg(F.count("*").alias("n"), F.avg("ml_confidence").alias("avg_confidence"), F.count_if("retried").alias("n_retries"), F.count_if("agree").alias("n_agree"))


@query(
    "obs",
    f""", w AS (SELECT *, created_at >= {NOW} - INTERVAL 14 DAY AS is_new FROM obs WHERE processed AND created_at >= {NOW} - INTERVAL 28 DAY),
n AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY is_new ORDER BY created_at DESC, id) <= 500),
e AS (SELECT prediction_error AS e, is_new FROM n WHERE prediction_error >= 0 AND coalesce(content_type, 'declarative') IN ('declarative', 'reflective')),
a AS (SELECT coalesce(avg(e) FILTER (is_new), 0) AS recent, coalesce(avg(e) FILTER (NOT is_new), 0) AS prior, count(*) FILTER (is_new) AS n_recent FROM e)
SELECT *, CASE WHEN recent - prior > 0.03 THEN 'rising' WHEN recent - prior < -0.03 THEN 'declining' ELSE 'stable' END AS trend, n_recent >= 5 AND recent < 0.10 AS saturated FROM a""",
)
def pe_saturation(spark, d):
    """Mean prediction error of the last 14 days and of the 14 before, of the newest 500 processed observations of each."""
    o = M.observations(spark, d).where("processed").where(F.col("created_at") >= before(28)).withColumn("is_new", F.col("created_at") >= before(14))
    o = top_k(o, 500, ["is_new"], F.desc("created_at"), "id").where("prediction_error >= 0").where(F.coalesce("content_type", F.lit("declarative")).isin("declarative", "reflective"))
    mean = lambda c: F.coalesce(F.avg(F.when(c, F.col("prediction_error"))), F.lit(0.0))
    a = o.agg(mean(F.col("is_new")).alias("recent"), mean(~F.col("is_new")).alias("prior"), F.count_if("is_new").alias("n_recent"))
    change = F.col("recent") - F.col("prior")
    return a.withColumns({"trend": F.when(change > 0.03, "rising").when(change < -0.03, "declining").otherwise("stable"), "saturated": (F.col("n_recent") >= 5) & (F.col("recent") < 0.10)})


@query("mem obs", "SELECT (SELECT count(*) FROM mem) AS memories, (SELECT count(*) FROM obs WHERE NOT processed) AS unprocessed")
def stats(spark, d):
    return M.memories(spark, d).agg(F.count("*").alias("memories")).crossJoin(M.observations(spark, d).agg(F.count_if(~F.col("processed")).alias("unprocessed")))  # one row each


@query("obs", f"SELECT count(*) FILTER (NOT processed) AS backlog, round(date_diff('millisecond', max(updated_at) FILTER (processed), {NOW}) / 3600000::double, 2) AS hours_since FROM obs")
def sleep_pressure(spark, d):
    o = M.observations(spark, d).agg(F.count_if(~F.col("processed")).alias("backlog"), F.max(F.when(F.col("processed"), F.col("updated_at"))).alias("last"))
    return o.select("backlog", F.round((F.unix_millis(S.now()) - F.unix_millis("last")) / 3_600_000, 2).alias("hours_since"))


_FEATURES = """sess AS (SELECT session, min(created_at) AS start_at, max(created_at) AS end_at, date_diff('millisecond', min(created_at), max(created_at)) / 60000::double AS duration_minutes,
  count(*) AS n_ops, max(regexp_matches(lower(content), 'commit|push|merge')::int) AS has_commits FROM op WHERE session IS NOT NULL AND created_at IS NOT NULL GROUP BY session
  HAVING NOT (date_diff('millisecond', min(created_at), max(created_at)) < 30000 AND count(*) < 3)),
feat AS (SELECT s.*, coalesce(t.n, 0) AS n_retrievals, coalesce(t.r / t.n::double, 0) AS retry_rate FROM sess s
  LEFT JOIN (SELECT session, count(*) AS n, count(*) FILTER (retried) AS r FROM tr GROUP BY session) t USING (session)),
near AS (SELECT f.session, count(o.id) AS n_observations FROM feat f LEFT JOIN obs o ON o.created_at >= f.start_at - INTERVAL 2 HOUR AND o.created_at <= f.start_at + INTERVAL 4 HOUR GROUP BY f.session)
"""


def feature_sql(select: str) -> str:
    return with_sql("op tr obs", "").rstrip() + ",\n" + _FEATURES + select


def session_table(spark, d):
    """Features of each session of the operations log: times, counts, retries, observations around its start."""
    o = M.ops(spark, d).where("session is not null and created_at is not null").groupBy("session")
    o = o.agg(F.min("created_at").alias("start_at"), F.max("created_at").alias("end_at"), F.count("*").alias("n_ops"), F.max(F.when(T.contains_any("content", T.COMMIT_WORDS), 1).otherwise(0)).alias("has_commits"))
    o = o.withColumn("duration_minutes", (F.unix_millis("end_at") - F.unix_millis("start_at")) / 60000).where("not (duration_minutes < 0.5 and n_ops < 3)")
    t = M.traces(spark, d).groupBy("session").agg(F.count("*").alias("n"), F.count_if("retried").alias("r"))
    f = o.join(t, "session", "left").select(*o.columns, F.coalesce("n", F.lit(0)).alias("n_retrievals"), F.coalesce(F.col("r") / F.col("n"), F.lit(0.0)).alias("retry_rate"))
    return f.join(around(f, M.observations(spark, d)), "session", "left").withColumn("n_observations", F.coalesce("n_observations", F.lit(0)))


def around(sessions: DataFrame, observations: DataFrame) -> DataFrame:
    """session, n_observations: those from two hours before its start to four after, both ends included.

    The number up to the end less the number before the start: both are running counts within a minute, plus those of
    the minutes before on that day and of the days before. So no session meets single observations, and only the days'
    sums (one row a day) are added up in one task."""
    micros = F.unix_micros("start_at")
    ends = F.array(*[F.struct((micros + h * F.lit(3_600_000_000)).alias("at"), F.lit(s).alias("sign"), F.lit(o).alias("nth")) for h, s, o in ((-2, -1, 0), (4, 1, 2))])
    asked = sessions.select("session", F.explode(ends).alias("e")).select("session", "e.*", F.lit(0).alias("n"))
    held = observations.where("created_at is not null").select(F.lit(None).cast("string").alias("session"), F.unix_micros("created_at").alias("at"), F.lit(0).alias("sign"), F.lit(1).alias("nth"), F.lit(1).alias("n"))
    both = asked.unionByName(held).withColumn("minute", F.floor(F.col("at") / 60_000_000))
    inside = F.sum("n").over(Window.partitionBy("minute").orderBy("at", "nth").rowsBetween(Window.unboundedPreceding, 0))
    minutes = both.groupBy("minute", F.floor(F.col("minute") / 1440).alias("day")).agg(F.sum("n").alias("n"))
    days = minutes.groupBy("day").agg(F.sum("n").alias("n"))
    upto = lambda *by: F.sum("n").over((Window.partitionBy(*by) if by else Window).orderBy(*(["minute"] if by else ["day"])).rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    minutes = minutes.withColumn("in_day", upto("day")).join(days.select("day", upto().alias("days")), "day").select("minute", (F.col("in_day") + F.col("days")).alias("before"))
    counted = both.withColumn("inside", inside).where("sign <> 0").join(minutes, "minute")
    return counted.groupBy("session").agg(F.sum(F.col("sign") * (F.col("inside") + F.col("before"))).alias("n_observations"))


FEATURES = ["session", "duration_minutes", "n_retrievals", "retry_rate", "n_ops", "has_commits", "n_observations"]


@query()
def session_features(spark, d):
    return session_table(spark, d).select(*FEATURES)


ORACLE["session_features"] = feature_sql("SELECT f.session, duration_minutes, n_retrievals, retry_rate, n_ops, has_commits, n_observations FROM feat f JOIN near USING (session)")


@query()
def feature_summary(spark, d):
    """Averages of the sessions' features."""
    return session_table(spark, d).agg(F.count("*").alias("n_sessions"), F.avg("duration_minutes").alias("avg_duration"), F.avg("n_retrievals").alias("avg_retrievals"), F.avg("retry_rate").alias("avg_retry_rate"), (F.avg("has_commits") * 100).alias("commit_percent"))


ORACLE["feature_summary"] = feature_sql("SELECT count(*) AS n_sessions, avg(duration_minutes) AS avg_duration, avg(n_retrievals) AS avg_retrievals, avg(retry_rate) AS avg_retry_rate, avg(has_commits) * 100 AS commit_percent FROM feat")


@query()
def anomaly_rules(spark, d):
    s = session_table(spark, d)
    c = F.col
    rules = [
        F.when((c("duration_minutes") > 60) & (c("has_commits") == 0), "long without commits"),
        F.when((c("retry_rate") > 0.3) & (c("n_retrievals") > 10), "many retries"),
        F.when((c("n_observations") > 5) & (c("n_ops") < 3), "observations without entries"),
        F.when((c("duration_minutes") < 2) & (c("has_commits") == 0) & (c("n_retrievals") == 0), "short and empty"),
        F.when(c("duration_minutes") > 180, "very long"),
        F.when((c("retry_rate") > 0.5) & (c("n_retrievals") > 5), "mostly retries"),
    ]
    return s.select("session", F.coalesce(F.nullif(F.concat_ws("; ", *rules), F.lit("")), F.lit("statistical outlier")).alias("explanation"))


ORACLE["anomaly_rules"] = feature_sql("""SELECT session, coalesce(nullif(concat_ws('; ',
  CASE WHEN duration_minutes > 60 AND has_commits = 0 THEN 'long without commits' END, CASE WHEN retry_rate > 0.3 AND n_retrievals > 10 THEN 'many retries' END,
  CASE WHEN n_observations > 5 AND n_ops < 3 THEN 'observations without entries' END, CASE WHEN duration_minutes < 2 AND has_commits = 0 AND n_retrievals = 0 THEN 'short and empty' END,
  CASE WHEN duration_minutes > 180 THEN 'very long' END, CASE WHEN retry_rate > 0.5 AND n_retrievals > 5 THEN 'mostly retries' END), ''), 'statistical outlier') AS explanation FROM feat JOIN near USING (session)""")


@query()
def session_anomalies(spark, d):
    """Sessions by isolation score, with the features that go into it."""
    s = session_table(spark, d).select(*FEATURES)
    return isolation_scores(s, "session", FEATURES[1:])


# Windows and behaviour


_WORDS = lambda c: f"list_distinct(list_filter(string_split_regex(lower({c}), '[^a-z0-9_]+'), lambda w: length(w) > 2))"
_REFORMULATED = f""", q AS (SELECT coalesce(session, 'unknown') AS session, coalesce(query_text, '') AS query_text, lag(coalesce(query_text, '')) OVER (PARTITION BY coalesce(session, 'unknown') ORDER BY coalesce("timestamp", to_timestamp(0)), trace_id) AS before FROM tr),
t AS (SELECT {_WORDS('query_text')} AS a, {_WORDS('before')} AS b FROM q WHERE before IS NOT NULL),
rf AS (SELECT count(*) AS n_pairs, count(*) FILTER (CASE WHEN len(a) + len(b) = 0 THEN 1.0 WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::double END > 0.5) AS n_reformulated FROM t)"""


@query("tr", _REFORMULATED + " SELECT n_pairs, n_reformulated FROM rf")
def reformulation_rate(spark, d):
    """Pairs of questions of a session that follow one another, and those of them that are alike. A session's days are
    tasks of their own."""
    t = M.traces(spark, d).select(F.coalesce("session", F.lit("unknown")).alias("session"), "trace_id", F.coalesce("query_text", F.lit("")).alias("query_text"), F.coalesce("timestamp", F.timestamp_seconds(F.lit(0))).alias("at"))
    t = previous(t.withColumn("day", F.to_date("at")), ["session"], "day", ["at", "trace_id"], "query_text", "before").where("before is not null")
    return t.agg(F.count("*").alias("n_pairs"), F.count_if(T.jaccard(F.array_distinct(T.long_words("query_text")), F.array_distinct(T.long_words("before"))) > 0.5).alias("n_reformulated"))


@query("tr", _REFORMULATED + " SELECT greatest(0, least(1, r.retried / r.n * 0.6 + CASE WHEN n_pairs > 0 THEN n_reformulated / n_pairs::double ELSE 0 END * 0.4)) AS frustration FROM rf, (SELECT count(*)::double AS n, count(*) FILTER (retried) AS retried FROM tr) r")
def vitals_frustration(spark, d):
    """Retries and reformulations."""
    t = M.traces(spark, d).agg(F.count("*").alias("n"), F.count_if("retried").alias("retried"))
    a = t.crossJoin(reformulation_rate(spark, d))  # one row each
    share = lambda x, n: F.when(F.col(n) > 0, F.col(x) / F.col(n)).otherwise(0.0)
    return a.select(S.clamp(share("retried", "n") * 0.6 + share("n_reformulated", "n_pairs") * 0.4, 0.0, 1.0).alias("frustration"))


@query(
    "obs",
    r""", s AS (SELECT id, content, unnest(list_filter(string_split_regex(content, '[.!?]+'), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13)) <> '')) AS s FROM obs WHERE content IS NOT NULL),
c AS (SELECT count(*) AS n, count(*) FILTER (regexp_matches(s, '(?i)\b(?:might|maybe|perhaps|possibly|not sure|i think|could be|probably|unclear|uncertain|seems like|not certain)\b')) AS h,
  count(*) FILTER (regexp_matches(s, '(?i)\b(?:clearly|definitely|obviously|i know|confirmed|proven|without doubt|certainly)\b')) AS a FROM s),
q AS (SELECT sum(length(content) - length(replace(content, '?', ''))) AS q FROM obs)
SELECT n AS n_sentences, h AS n_hedging, a AS n_assertive, greatest(0, least(1, greatest(0, n - q) / n::double * 0.3 + CASE WHEN h + a > 0 THEN 1 - h / (h + a)::double ELSE 0.5 END * 0.7)) AS confidence FROM c, q""",
)
def vitals_confidence(spark, d):
    o = M.observations(spark, d).where("content is not null")
    sentences = F.filter(F.split("content", "[.!?]+"), lambda s: F.btrim(s, F.lit(" \t\n\r")) != "")
    counted = lambda words: F.size(F.filter("s", lambda s: T.any_word(s, words)))
    a = o.select("content", sentences.alias("s")).agg(
        F.sum(F.size("s")).alias("n_sentences"), F.sum(counted(T.HEDGES)).alias("n_hedging"), F.sum(counted(T.ASSERTIONS)).alias("n_assertive"), F.sum(F.length("content") - F.length(F.replace("content", F.lit("?"), F.lit("")))).alias("q")
    )
    n, h, s = F.col("n_sentences"), F.col("n_hedging"), F.col("n_assertive")
    sure = F.when(h + s > 0, 1 - h / (h + s)).otherwise(0.5)
    return a.select("n_sentences", "n_hedging", "n_assertive", S.clamp(F.greatest(F.lit(0), n - F.col("q")) / n * 0.3 + sure * 0.7, 0.0, 1.0).alias("confidence"))


@query("tr", f""", k AS (SELECT array_to_string(list_filter(string_split_regex(lower(coalesce(query_text, '')), '[^a-z0-9_]+'), lambda w: length(w) > 2)[1:2], '_') AS topic, detected_intent, tool FROM tr),
a AS (SELECT count(DISTINCT nullif(topic, '')) AS n_topics, count(*) FILTER (tool = 'wander') / count(*)::double AS wander_share, count(*) FILTER (detected_intent NOT IN ('operational', 'ambiguous', '')) / count(*)::double AS novelty FROM k)
SELECT *, greatest(0, least(1, least(1, n_topics / 20::double) * 0.4 + wander_share * 0.3 + novelty * 0.3)) AS curiosity FROM a""")
def vitals_curiosity(spark, d):
    """Different topics, walks, and questions that are not about operations."""
    share = lambda c: F.count_if(c) / F.count("*")
    a = M.traces(spark, d).agg(F.count_distinct(F.nullif(T.topic_key("query_text"), F.lit(""))).alias("n_topics"), share(F.col("tool") == "wander").alias("wander_share"), share(~F.col("detected_intent").isin("operational", "ambiguous", "")).alias("novelty"))
    return a.withColumn("curiosity", S.clamp(F.least(F.lit(1.0), F.col("n_topics") / 20) * 0.4 + F.col("wander_share") * 0.3 + F.col("novelty") * 0.3, 0.0, 1.0))


@query("mem thr obs op edg", f"""SELECT (SELECT greatest(0, least(1, (SELECT count(*) FROM edg WHERE created_at >= {NOW} - INTERVAL 30 DAY) / greatest(count(*), 1)::double)) FROM obs WHERE created_at >= {NOW} - INTERVAL 30 DAY) AS creative_energy,
  (SELECT greatest(0, least(1, (SELECT coalesce(sum(len(updates)), 0) FROM thr) / greatest(count(*), 1)::double)) FROM op WHERE created_at >= {NOW} - INTERVAL 30 DAY) AS connection""")
def vitals_energy(spark, d, days: int = 30):
    """New edges for each observation, and thread updates for each entry of the operations log, of the last `days`."""
    since = F.col("created_at") >= before(days)
    e = M.edges(spark, d).where(since).agg(F.count("*").alias("e"))
    o = M.observations(spark, d).where(since).agg(F.count("*").alias("o"))
    u = M.threads(spark, d).agg(F.coalesce(F.sum(F.greatest(F.size("updates"), F.lit(0))), F.lit(0)).alias("u"))
    p = M.ops(spark, d).where(since).agg(F.count("*").alias("p"))
    all_ = e.crossJoin(o).crossJoin(u).crossJoin(p)  # one row each
    share = lambda x, n: S.clamp(F.col(x) / F.greatest(F.col(n), F.lit(1)), 0.0, 1.0)
    return all_.select(share("e", "o").alias("creative_energy"), share("u", "p").alias("connection"))


@query(
    "obs tr",
    """, h AS (SELECT DISTINCT date_trunc('hour', "timestamp") AS h FROM tr)
SELECT avg(prediction_error) FILTER (h.h IS NOT NULL) AS with_retrieval, avg(prediction_error) FILTER (h.h IS NULL) AS without_retrieval,
  avg(prediction_error) FILTER (h.h IS NOT NULL) - avg(prediction_error) FILTER (h.h IS NULL) AS delta FROM obs LEFT JOIN h ON h.h = date_trunc('hour', obs.created_at)""",
)
def pe_delta(spark, d):
    """Prediction error of observations in hours with and without retrieval."""
    hours = M.traces(spark, d).select(F.date_trunc("hour", "timestamp").alias("h"), F.lit(True).alias("yes")).distinct()
    o = M.observations(spark, d).withColumn("h", F.date_trunc("hour", "created_at")).join(hours, "h", "left")
    a = o.agg(F.avg(F.when(F.col("yes"), F.col("prediction_error"))).alias("with_retrieval"), F.avg(F.when(F.col("yes").isNull(), F.col("prediction_error"))).alias("without_retrieval"))
    return a.withColumn("delta", F.col("with_retrieval") - F.col("without_retrieval"))


@query("obs", "SELECT date_trunc('day', updated_at)::date::varchar AS day, count(*) AS n, count(*) FILTER (processed) / count(*)::double AS integration_rate FROM obs WHERE updated_at IS NOT NULL GROUP BY 1 ORDER BY day DESC LIMIT 7")
def consolidation_trend(spark, d):
    o = M.observations(spark, d).where("updated_at is not null").groupBy(F.date_format("updated_at", "yyyy-MM-dd").alias("day"))
    return o.agg(F.count("*").alias("n"), (F.count_if("processed") / F.count("*")).alias("integration_rate")).orderBy(F.desc("day")).limit(7)


# Scores

_DAYS = lambda c: f"coalesce(date_diff('millisecond', {c}, {NOW}) / 86400000::double, 0)"
_R = f"power(1 + (power(0.9, -2) - 1) * {_DAYS('fsrs.last_review')} / fsrs.stability, -0.5)"


@query("mem", f"SELECT id, {_R} AS retrievability FROM mem WHERE fsrs.stability > 0")
def fsrs_retrievability(spark, d):
    m = M.memories(spark, d).where("fsrs.stability > 0")
    return m.select("id", S.retrievability(F.col("fsrs.stability"), S.days_since("fsrs.last_review")).alias("retrievability"))


_RATING = "access_count % 4 + 1"
_SCHEDULE = f""", s AS (SELECT id, fsrs.state AS st, fsrs.stability AS s0, fsrs.difficulty AS d0, {_RATING} AS g, {_R} AS r FROM mem WHERE fsrs.stability > 0 AND access_count IS NOT NULL),
d AS (SELECT *, CASE WHEN st = 'new' THEN 7.2102::double - 0.5316 * (g - 3) ELSE greatest(1::double, least(10::double, d0 - 1.0651 * (g - 3) + 0.0589 * (7.2102 - d0))) END AS difficulty FROM s),
t AS (SELECT *, CASE WHEN st = 'new' THEN greatest([0.4072, 1.1829, 3.1262, 15.4722][g]::double, 0.1)
  WHEN g = 1 THEN 1.9395 * power(difficulty, -0.11) * (power(s0 + 1, 0.2918) - 1) * exp((1 - r) * 0.5)
  ELSE s0 * (exp(1.506) * (11 - difficulty) * power(s0, -0.14) * (exp((1 - r) * 1.0036) - 1) * CASE g WHEN 4 THEN 2.0 ELSE 1.0 END) + s0 END AS stability FROM d)
SELECT id, stability, difficulty, greatest(1, floor(stability + 0.5))::bigint AS interval_days, CASE WHEN g = 1 THEN 'relearning' WHEN st = 'new' THEN 'learning' ELSE 'review' END AS state FROM t"""


@query("mem", _SCHEDULE)
def fsrs_schedule(spark, d):
    m = M.memories(spark, d).where("fsrs.stability > 0 and access_count is not null")
    s = S.schedule(F.col("fsrs.state"), F.col("fsrs.stability"), F.col("fsrs.difficulty"), F.expr(_RATING), S.days_since("fsrs.last_review"))
    return m.select("id", s.alias("s")).select("id", "s.*")


_CONTRADICTED = """, cv AS (SELECT id, embedding::double[] AS v FROM mem WHERE len(embedding) = 128 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
ca AS (SELECT obs.id, embedding::double[] AS v FROM obs JOIN sig ON sig.observation_id = obs.id WHERE type = 'CONTRADICTION' AND NOT resolved AND len(embedding) = 128 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
cn AS (SELECT ca.id AS query_id, cv.id, list_cosine_similarity(ca.v, cv.v) AS score FROM ca, cv QUALIFY row_number() OVER (PARTITION BY ca.id ORDER BY round(score, 9) DESC, cv.id) <= 5),
cg AS (SELECT query_id, avg(score) AS density, greatest(0, max(score)) AS best, first(id ORDER BY score DESC, id) AS id FROM cn GROUP BY query_id),
contra AS (SELECT DISTINCT v AS id FROM (SELECT unnest([source_id, target_id]) AS v FROM edg WHERE relation IN ('contradicts', 'tensions-with')
  UNION ALL SELECT lower(id) FROM cg WHERE best > greatest(0.35, least(0.65, 0.5 + (density - 0.5) * 0.15))))"""


def contradicted(spark, d):
    """The ends of edges of contradiction or tension, and the memories of open CONTRADICTION signals."""
    e = M.edges(spark, d).where(F.col("relation").isin("contradicts", "tensions-with"))
    open_ = M.signals(spark, d).where("type = 'CONTRADICTION' and not resolved")
    signalled = M.signal_concepts(spark, d, open_).select(F.col("concept_id").alias("id"))
    return e.select(F.explode(F.array("source_id", "target_id")).alias("id")).unionByName(signalled).distinct()


@query("mem edg sig", _CONTRADICTED + " SELECT id FROM contra")
def contradicted_ids(spark, d):
    return contradicted(spark, d)


@query("mem", f"SELECT id FROM mem WHERE fsrs.state IN ('review', 'learning', 'relearning') AND (fsrs.last_review IS NULL OR {_DAYS('fsrs.last_review')} >= greatest(CASE WHEN fsrs.state = 'review' THEN 1.0 ELSE 0.5 END, 0.8 * fsrs.stability))")
def due_for_review(spark, d):
    return M.memories(spark, d).where(S.due(F.col("fsrs.state"), F.col("fsrs.stability"), F.col("fsrs.last_review"))).select("id")


@query(
    "mem edg sig",
    _CONTRADICTED
    + f""", b AS (SELECT m.id, c.id IS NOT NULL AS contradicted, last_retrieval_score AS sc, last_hop_count AS hop, CASE WHEN {_DAYS('last_accessed')} <= CASE WHEN fsrs.state = 'relearning' THEN 1 ELSE 3 END THEN 3 ELSE 2 END AS base
  FROM mem m LEFT JOIN contra c ON c.id = lower(m.id)),
u AS (SELECT *, least(4, base + CASE WHEN sc > 0.92 AND coalesce(hop, 0) = 0 THEN 1 ELSE 0 END) AS up FROM b),
v AS (SELECT *, greatest(1, up - CASE WHEN coalesce(sc < 0.75, false) OR coalesce(hop > 0, false) THEN 1 ELSE 0 END) AS dn FROM u)
SELECT id, greatest(1, dn - contradicted::int)::int AS rating FROM v""",
)
def dream_rating(spark, d):
    m = M.memories(spark, d).withColumn("k", F.lower("id")).join(contradicted(spark, d).select(F.col("id").alias("k"), F.lit(True).alias("c")), "k", "left")
    return m.select("id", S.consolidation_rating(S.days_since("last_accessed"), F.col("fsrs.state"), F.col("last_retrieval_score"), F.col("last_hop_count"), F.coalesce("c", F.lit(False))).alias("rating"))


@query("mem edg", "SELECT id, fsrs.stability AS stability FROM mem WHERE fsrs.state = 'review' AND fsrs.stability >= 21 AND fsrs.lapses = 0 AND fsrs.reps >= 4 AND confidence >= 0.7 AND NOT coalesce(faded, false) AND lower(id) NOT IN (SELECT source_id FROM edg WHERE relation IN ('contradicts', 'tensions-with')) ORDER BY stability DESC, id LIMIT 5")
def hindsight_candidates(spark, d):
    m = M.memories(spark, d).where("fsrs.state = 'review' and fsrs.stability >= 21 and fsrs.lapses = 0 and fsrs.reps >= 4 and confidence >= 0.7 and not coalesce(faded, false)")
    doubted = M.edges(spark, d).where(F.col("relation").isin("contradicts", "tensions-with")).select(F.col("source_id").alias("k"))
    return m.withColumn("k", F.lower("id")).join(doubted, "k", "left_anti").select("id", F.col("fsrs.stability").alias("stability")).orderBy(F.desc("stability"), "id").limit(5)


@query(
    "mem edg",
    f""", ends AS (SELECT DISTINCT unnest([source_id, target_id]) AS v FROM edg),
p AS (SELECT id, [CASE WHEN salience < 0.15 THEN 'salience' END, CASE WHEN access_count < 3 THEN 'access' END, CASE WHEN fsrs.state = 'relearning' THEN 'relearning' END,
  CASE WHEN lower(id) NOT IN (SELECT v FROM ends) THEN 'orphan' END, CASE WHEN {_DAYS('created_at')} > 60 THEN 'age' END] AS r FROM mem)
SELECT id, len(list_filter(r, lambda x: x IS NOT NULL)) AS score, array_to_string(list_filter(r, lambda x: x IS NOT NULL), ' ') AS reasons FROM p WHERE len(list_filter(r, lambda x: x IS NOT NULL)) >= 3""",
)
def prune_candidates(spark, d):
    ends = M.edges(spark, d).select(F.explode(F.array("source_id", "target_id")).alias("k")).distinct().withColumn("linked", F.lit(True))
    m = M.memories(spark, d).withColumn("k", F.lower("id")).join(ends, "k", "left")
    r = F.array_compact(F.array(F.when(F.col("salience") < 0.15, "salience"), F.when(F.col("access_count") < 3, "access"), F.when(F.col("fsrs.state") == "relearning", "relearning"), F.when(F.col("linked").isNull(), "orphan"), F.when(S.days_since("created_at") > 60, "age")))
    return m.select("id", r.alias("r")).where(F.size("r") >= 3).select("id", F.size("r").cast("bigint").alias("score"), F.array_join("r", " ").alias("reasons"))


@query("mem", f"SELECT id, CASE WHEN access_count < 3 THEN 0.3::double ELSE 0 END + CASE WHEN confidence < 0.5 THEN 0.2::double ELSE 0 END + CASE WHEN category = 'goal' THEN 0.4::double ELSE 0 END + CASE WHEN {_DAYS('last_accessed')} > 14 THEN 0.2::double ELSE 0 END AS score FROM mem")
def epistemic_score(spark, d):
    return M.memories(spark, d).select("id", S.epistemic(F.col("access_count"), F.col("confidence"), F.col("category"), S.days_since("last_accessed")).alias("score"))


@query("mem", "SELECT access_count AS n, CASE WHEN access_count <= 1 THEN 0 WHEN access_count = 2 THEN 1 ELSE 2 * (ln(access_count - 1) + 0.5772156649::double) - 2 * (access_count - 1) / access_count::double END AS path FROM (SELECT DISTINCT access_count FROM mem WHERE access_count IS NOT NULL)")
def avg_path_length(spark, d):
    return M.memories(spark, d).where("access_count is not null").select(F.col("access_count").alias("n")).distinct().select("n", S.average_path(F.col("n")).alias("path"))


# Texts


@query("", "SELECT doc_id, len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]{2,}')) AS n_tokens, len(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]{2,}'))) AS n_distinct FROM documents")
def tokenize(spark, d):
    t = T.tokenize("text")
    return table(spark, d, "documents").select("doc_id", F.size(t).cast("bigint").alias("n_tokens"), F.size(F.array_distinct(t)).cast("bigint").alias("n_distinct"))


_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_KEYWORDS = lambda c: f"""list_filter(list_transform(string_split_regex(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9\\s''-]', ' ', 'g'), '\\s+'), lambda w: trim(w, '''-')), lambda w: length(w) >= 3 AND w NOT IN ({_STOP}) AND NOT regexp_full_match(w, '[0-9]+'))"""
_FIRSTS = lambda c, n: f"list_transform(list_sort(list_transform(list_distinct({_KEYWORDS(c)}), lambda w: struct_pack(p := list_position({_KEYWORDS(c)}, w), w := w))), lambda s: s.w)[1:{n}]"


@query("obs", f"SELECT id, array_to_string({_FIRSTS('content', 20)}, ' ') AS keywords FROM obs")
def keywords(spark, d):
    return M.observations(spark, d).select("id", F.array_join(T.keywords("content"), " ").alias("keywords"))


@query("obs", "SELECT id, " + "CASE" + "".join(f" WHEN regexp_matches(lower(coalesce(content, '')), '{p}') THEN '{n}'" for p, n in T.CATEGORIES) + " ELSE 'observation' END AS category FROM obs")
def infer_category(spark, d):
    return M.observations(spark, d).select("id", T.infer_category("content").alias("category"))


@query(
    "obs",
    r""", t AS (SELECT id, trim(regexp_replace(coalesce(content, ''), '\s+', ' ', 'g')) AS t FROM obs), w AS (SELECT *, regexp_extract(t, '^[^.!?]+[.!?]') AS s, string_split(t, ' ') AS w FROM t),
p AS (SELECT *, list_filter(list_transform(range(1, least(len(w), 60) + 1), lambda i: array_to_string(w[1:i], ' ')), lambda x: length(regexp_replace(x, '[.,;:!?]+$', '')) <= 59) AS p FROM w),
b AS (SELECT *, CASE WHEN len(p) > 0 THEN regexp_replace(p[-1], '[\s.,;:!?]+$', '') ELSE '' END AS b FROM p)
SELECT id, CASE WHEN s <> '' AND length(s) <= 60 THEN trim(regexp_replace(s, '[.!?]+$', '')) WHEN length(t) <= 60 THEN t WHEN b <> '' THEN b || '…' ELSE trim(substring(t, 1, 59)) || '…' END AS name FROM b""",
)
def derive_name(spark, d):
    return M.observations(spark, d).select("id", T.derive_name("content").alias("name"))


@query("mem", f", k AS (SELECT id, {_FIRSTS('name', 50)} AS a, {_FIRSTS('definition', 500)} AS b FROM mem) SELECT id, CASE WHEN len(a) = 0 THEN 1 ELSE len(list_intersect(a, b)) / len(a)::double END AS grounding FROM k")
def grounding(spark, d):
    """How much of a memory's name is in its definition."""
    return M.memories(spark, d).select("id", T.grounding("name", "definition").alias("grounding"))


_HITS = " + ".join(f"contains(lower(t), '{p}')::int" for p in T.GENERIC_PHRASES)
_META = " OR ".join(f"regexp_matches(lower(t), '{p}')" for p in T.META_OPENERS)


@query(
    "mem",
    rf""", t AS (SELECT id, trim(coalesce(definition, ''), ' ' || chr(9) || chr(13) || chr(10)) AS t FROM mem), h AS (SELECT *, {_HITS} AS hits FROM t)
SELECT id, array_to_string(list_filter([CASE WHEN length(t) < 20 THEN 'too_short' END, CASE WHEN length(t) > 2000 THEN 'too_long' END,
  CASE WHEN t <> '' AND NOT regexp_matches(t, '[.!?]["'')\]]?$') THEN 'no_sentence_end' END, CASE WHEN regexp_matches(t, '^(#{{1,6}}\s|\*\*)') THEN 'markdown' END, CASE WHEN {_META} THEN 'meta_opener' END,
  CASE WHEN regexp_matches(t, '\bConcept\s+[A-Z]\b') THEN 'placeholder' END, CASE WHEN hits >= 2 THEN 'generic' END, CASE WHEN hits = 1 THEN 'generic_unchecked' END], lambda x: x IS NOT NULL), ' ') AS problems FROM h""",
)
def assess_thought(spark, d):
    return M.memories(spark, d).select("id", F.array_join(T.assess_thought("definition"), " ").alias("problems"))


@query("", """SELECT doc_id, i AS chunk, CASE WHEN i = 0 THEN substring(text, 1, 2000) ELSE substring(text, 2001 + (i - 1) * 500, 500) END AS content
FROM (SELECT doc_id, coalesce(text, '') AS text, unnest(range(0, 1 + greatest(0, ceil((length(coalesce(text, '')) - 2000) / 500.0))::bigint)) AS i FROM documents)""")
def digest_chunks(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(T.chunks("text")).alias("chunk", "content")).withColumn("chunk", F.col("chunk").cast("bigint"))


@query("op", "SELECT id, created_at + to_days(CASE type WHEN 'handoff' THEN 14 WHEN 'milestone' THEN 365 WHEN 'decision' THEN 365 ELSE 30 END) AS expires_at FROM op WHERE created_at IS NOT NULL")
def ops_ttl(spark, d):
    days = F.when(F.col("type") == "handoff", 14).when(F.col("type").isin("milestone", "decision"), 365).otherwise(30)
    return M.ops(spark, d).where("created_at is not null").select("id", F.timestamp_micros(F.unix_micros("created_at") + days * F.lit(86_400_000_000)).alias("expires_at"))


@query(
    "",
    r"""WITH d AS (SELECT doc_id, lower(kind) AS kind, regexp_extract(coalesce(text, ''), '^---\r?\n((?s:.*?))\r?\n---', 1) AS fm, length(regexp_replace(coalesce(text, ''), '^---\r?\n(?s:.*?)\r?\n---\r?\n?', '')) AS size FROM documents),
f AS (SELECT *, try_cast(regexp_extract(fm, '(?mi)^salience:\s*(\S+)', 1) AS double) AS own, lower(regexp_extract(fm, '(?mi)^status:\s*(\w+)', 1)) AS status, coalesce(nullif(lower(regexp_extract(fm, '(?mi)^type:\s*(\w+)', 1)), ''), kind) AS type FROM d)
SELECT doc_id, CASE WHEN own IS NOT NULL THEN greatest(1, least(10, own)) WHEN status = 'active' THEN 7 WHEN status = 'archived' THEN 3 WHEN type IN ('mind', 'journal') THEN 7 WHEN type = 'knowledge' THEN 6
  WHEN size > 3000 THEN 7 WHEN size > 1000 THEN 6 ELSE 5 END::double AS salience FROM f""",
)
def detect_salience(spark, d):
    """From the front matter (salience, status, type; the table's kind stands for a missing type), else from the length."""
    meta = table(spark, d, "documents").select("doc_id", T.front_matter("text").alias("m"), F.lower("kind").alias("kind"), F.length(T.body("text")).alias("size"))
    of = lambda k: F.try_element_at("m", F.lit(k))
    own, status, type_ = of("salience").try_cast("double"), F.lower(of("status")), F.coalesce(F.lower(of("type")), F.col("kind"))
    value = F.when(own.isNotNull(), S.clamp(own, 1, 10)).when(status == "active", 7).when(status == "archived", 3).when(type_.isin("mind", "journal"), 7).when(type_ == "knowledge", 6).when(F.col("size") > 3000, 7).when(F.col("size") > 1000, 6).otherwise(5)
    return meta.select("doc_id", value.cast("double").alias("salience"))


# Wording of memories that are values or patterns.
VALUE_SIGNS = ("loyalty", "honesty", "transparency", "integrity", "absolute transparency", "no hidden state", "genuinely useful", "usefulness over", "continuity matters", "grow genuinely", "worth having around", "honest about limits")
PATTERN_SIGNS = ("disposition", "tendency", "practical and direct", "pushes back", "read before acting", "tinkerer", "goes wide before", "go wide before")
YES_PREFIX = r"(?i)\A(?:YES[:\s]*\n*(?:Updated\s+)?(?:Definition[:\s]*)?\n*)"
_ANY = lambda words: "(" + " OR ".join(f"contains(w, '{x}')" for x in words) + ")"


@query(
    "mem",
    rf""", c AS (SELECT *, coalesce(definition, '') AS def, trim(regexp_replace(coalesce(definition, ''), '(?i)^(?:YES[:\s]*\n*(?:Updated\s+)?(?:Definition[:\s]*)?\n*)', ''), ' ' || chr(9) || chr(10) || chr(13)) AS clean FROM mem),
f AS (SELECT *, CASE WHEN clean <> def THEN clean WHEN def = '' THEN name ELSE definition END AS new_def FROM c),
g AS (SELECT *, lower(coalesce(name, '') || ' ' || coalesce(new_def, '')) AS w FROM f),
h AS (SELECT *, CASE WHEN category IN ('topic', 'belief') THEN CASE WHEN {_ANY(VALUE_SIGNS)} OR regexp_matches(w, '\bvalue[sd]?\b') THEN 'value' WHEN category = 'topic' AND {_ANY(PATTERN_SIGNS)} THEN 'pattern' END END AS better FROM g)
SELECT id, array_to_string(list_filter([CASE WHEN trim(def, ' ' || chr(9) || chr(10) || chr(13)) = '' THEN 'empty' END, CASE WHEN clean <> def THEN 'prefix' END, CASE WHEN coalesce(len(embedding), 0) = 0 THEN 'embedding' END, CASE WHEN salience < 0 OR salience > 1 THEN 'salience' END,
  CASE WHEN access_count IS NULL THEN 'access' END, CASE WHEN better IS NOT NULL THEN 'category' END], lambda x: x IS NOT NULL), ' ') AS issues, new_def AS definition, greatest(0, least(1, salience)) AS salience, coalesce(access_count, 0) AS access_count, coalesce(better, category) AS category FROM h""",
)
def maintain_fix(spark, d):
    """What is wrong with each memory, and its mended fields; a missing embedding is left to re-embedding."""
    blanks = F.lit(" \t\n\r")
    m = M.memories(spark, d).withColumn("def", T.text_of("definition")).withColumn("clean", F.btrim(F.regexp_replace("def", YES_PREFIX, ""), blanks))
    m = m.withColumn("new_def", F.when(F.col("clean") != F.col("def"), F.col("clean")).when(F.col("def") == "", F.col("name")).otherwise(F.col("definition")))
    words = F.lower(F.concat(T.text_of("name"), F.lit(" "), T.text_of("new_def")))
    value = T.contains_any(words, VALUE_SIGNS) | words.rlike(r"\bvalue[sd]?\b")
    m = m.withColumn("better", F.when(F.col("category").isin("topic", "belief"), F.when(value, "value").when((F.col("category") == "topic") & T.contains_any(words, PATTERN_SIGNS), "pattern")))
    checks = {
        "empty": F.btrim("def", blanks) == "", "prefix": F.col("clean") != F.col("def"), "embedding": F.coalesce(F.size("embedding"), F.lit(0)) <= 0,
        "salience": (F.col("salience") < 0) | (F.col("salience") > 1), "access": F.col("access_count").isNull(), "category": F.col("better").isNotNull(),
    }
    issues = F.array_compact(F.array(*[F.when(c, name) for name, c in checks.items()]))
    return m.select("id", F.array_join(issues, " ").alias("issues"), F.col("new_def").alias("definition"), S.clamp(F.col("salience"), 0.0, 1.0).alias("salience"), F.coalesce("access_count", F.lit(0)).alias("access_count"), F.coalesce("better", "category").alias("category"))


@query("thr mem obs", """SELECT * FROM (SELECT 'thread' AS kind, id, priority AS rank FROM thr WHERE status IN ('open', 'active') ORDER BY priority DESC NULLS LAST, id LIMIT 5)
UNION ALL SELECT * FROM (SELECT 'observation' AS kind, id, salience AS rank FROM obs ORDER BY created_at DESC, id LIMIT 10)""")
def ruminate_context(spark, d):
    t = M.threads(spark, d).where(F.col("status").isin("open", "active")).select(F.lit("thread").alias("kind"), "id", F.col("priority").alias("rank")).orderBy(F.desc_nulls_last("rank"), "id").limit(5)
    o = M.observations(spark, d).orderBy(F.desc("created_at"), "id").limit(10).select(F.lit("observation").alias("kind"), "id", F.col("salience").alias("rank"))
    return t.unionByName(o)


@query("", """SELECT query_id, id, source_agent, name, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, result_id) AS n FROM (SELECT DISTINCT query_id, result_id, id, source_agent, name, score FROM federation_results WHERE score >= 0.4)) WHERE n <= 10""")
def federated_query(spark, d):
    """The ten best answers of all peers to each query."""
    r = table(spark, d, "federation_results").where("score >= 0.4").select("query_id", "result_id", "id", "source_agent", "name", "score").distinct()
    return top_k(r, 10, ["query_id"], F.desc("score"), "result_id").drop("result_id")


ORACLE["digest_observe"] = f"""SELECT c.doc_id, chunk, length(content) AS n_chars, CASE WHEN chunk = 0 THEN salience ELSE greatest(1, salience - 2) END AS salience
FROM ({ORACLE['digest_chunks']}) c JOIN ({ORACLE['detect_salience']}) s ON s.doc_id = c.doc_id WHERE content <> ''"""


@query()
def digest_observe(spark, d):
    """The observations that a digest of each document makes: its head at the document's salience, the further chunks at
    two less (1 at least). Empty texts make none."""
    c = digest_chunks(spark, d).where("content <> ''").join(detect_salience(spark, d), "doc_id")
    return c.select("doc_id", "chunk", F.length("content").cast("bigint").alias("n_chars"), F.when(F.col("chunk") == 0, F.col("salience")).otherwise(F.greatest(F.lit(1.0), F.col("salience") - 2)).alias("salience"))


_PRUNED = ORACLE["prune_candidates"].rsplit("SELECT id, len(list_filter", 1)[0]
ORACLE["health_prune"] = _PRUNED + "SELECT mem.id, coalesce(faded, false) OR len(list_filter(p.r, lambda x: x IS NOT NULL)) >= 3 AS faded FROM mem JOIN p USING (id)"


@query()
def health_prune(spark, d):
    """All memories, with the prune candidates faded."""
    lost = prune_candidates(spark, d).select("id")
    return updates.changed(M.memories(spark, d).select("id", F.coalesce("faded", F.lit(False)).alias("faded")), lost, "_hit", faded=F.lit(True))


@query("mem", """, n AS (SELECT coalesce(namespace, '(none)') AS namespace, coalesce(category, '(none)') AS category, count(*) AS n FROM mem GROUP BY ALL)
SELECT namespace, '{' || string_agg('"' || category || '":' || n, ',' ORDER BY category) || '}' AS histogram FROM n GROUP BY namespace""")
def category_histogram(spark, d):
    """A map of each namespace's categories to their numbers, as JSON."""
    n = M.memories(spark, d).groupBy(F.coalesce("namespace", F.lit("(none)")).alias("namespace"), F.coalesce("category", F.lit("(none)")).alias("category")).agg(F.count("*").alias("n"))
    entries = F.array_sort(F.collect_list(F.struct("category", "n")))  # a fixed set of names
    return n.groupBy("namespace").agg(F.to_json(F.map_from_entries(entries)).alias("histogram"))


@query("", """SELECT event_id, json_extract_string(p, '$.k') AS k, json_extract_string(p, '$.kind') AS kind, len(json_keys(p)) AS n_keys
FROM (SELECT event_id, json_merge_patch(CASE WHEN json_valid(props) THEN props::json ELSE '{}'::json END, json_object('kind', event_type)) AS p FROM events)""")
def merged_props(spark, d):
    """The events' JSON properties (none if they are malformed), with the event's type merged into them."""
    old = F.coalesce(F.from_json("props", "map<string,string>"), F.create_map().cast("map<string,string>"))
    new = F.create_map(F.lit("kind"), F.col("event_type"))
    both = F.map_concat(F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(new), k)), new)
    return table(spark, d, "events").select("event_id", both.alias("p")).select("event_id", F.try_element_at("p", F.lit("k")).alias("k"), F.try_element_at("p", F.lit("kind")).alias("kind"), F.size("p").cast("bigint").alias("n_keys"))


@query("thr", """SELECT id, array_to_string(list_concat([coalesce(title, '')], list_transform(coalesce(updates, []), lambda u: coalesce(u."content", '')))[1:100], ' | ') AS log,
  coalesce(len(session_refs), 0) + CASE WHEN project IS NULL OR coalesce(list_contains(session_refs, project), false) THEN 0 ELSE 1 END AS n_refs FROM thr""")
def thread_log(spark, d):
    """Each thread's log with the title put before it, the first hundred entries; the number of its references once the
    project is appended to them, if it is absent."""
    log = updates.prepended(F.transform(F.coalesce("updates", F.array().cast("array<struct<timestamp: timestamp, content: string, session_ref: string>>")), lambda u: T.text_of(u["content"])), T.text_of("title"), 100)
    refs = updates.appended(F.col("session_refs"), F.col("project"))
    return M.threads(spark, d).select("id", F.array_join(log, " | ").alias("log"), F.size(refs).cast("bigint").alias("n_refs"))


@query("mem", "SELECT id, name, category, updated_at FROM mem WHERE id = (SELECT min(id) FROM memories)")
def point_lookup(spark, d):
    """One memory by its id; the filter reaches the scan."""
    first = table(spark, d, "memories").agg(F.min("id")).first()[0]  # one value
    return M.memories(spark, d).where(F.col("id") == first).select("id", "name", "category", "updated_at")


@query("sig", """, leg AS (SELECT 'sig-' || id AS id, 'NOTICE' AS type, prediction_error AS priority, created_at FROM obs WHERE prediction_error >= 0.3)
SELECT id, type, priority, created_at FROM sig UNION ALL SELECT id, type, priority, created_at FROM leg WHERE id NOT IN (SELECT id FROM sig)""")
def signals_union(spark, d):
    """Signals of two sources, of which the typed one wins where both have an id; the other here has lesser surprises too."""
    legacy = M.observations(spark, d).where("prediction_error >= 0.3").select(F.concat(F.lit("sig-"), "id").alias("id"), F.lit("NOTICE").alias("type"), F.col("prediction_error").alias("priority"), "created_at")
    return filters.upsert(legacy, M.signals(spark, d).select("id", "type", "priority", "created_at"), "id")


@query("tr", """SELECT before_id AS trace_id, trace_id AS retried_by, date_diff('millisecond', before_at, "timestamp") AS gap_ms FROM (
  SELECT *, lag(trace_id) OVER (PARTITION BY session ORDER BY "timestamp", trace_id) AS before_id, lag("timestamp") OVER (PARTITION BY session ORDER BY "timestamp", trace_id) AS before_at FROM tr WHERE session IS NOT NULL AND "timestamp" IS NOT NULL)
WHERE date_diff('millisecond', before_at, "timestamp") <= 60000""")
def retries_within_a_minute(spark, d):
    """Traces that another one of their session follows within a minute. A session's days are tasks of their own."""
    t = M.traces(spark, d).where("session is not null and timestamp is not null").select("session", "trace_id", F.col("timestamp").alias("at"), F.to_date("timestamp").alias("day"))
    t = t.withColumn("this", F.struct("trace_id", "at"))
    t = previous(t, ["session"], "day", ["at", "trace_id"], "this", "before").where("before is not null")
    gap = F.unix_millis("at") - F.unix_millis("before.at")
    return t.where(gap <= 60_000).select(F.col("before.trace_id").alias("trace_id"), F.col("trace_id").alias("retried_by"), gap.alias("gap_ms"))
