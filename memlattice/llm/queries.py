"""Queries of the operators of this subpackage, with their SQL."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlattice.llm import clusters, near_duplicates, neighbours, packing, skeleton, tokens
from memlattice.tables import materialize, table
from memlattice.vectors import one_per_id

DIM = 128


def retold(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "federation_results").select(F.lit("federation_results").alias("source"), F.col("result_id").alias("key"), F.col("definition").alias("text"))
    return found.unionByName(table(spark, sf_dir, "threads").select(F.lit("threads").alias("source"), F.col("id").alias("key"), F.col("body").alias("text")))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = near_duplicates.expanded(*near_duplicates.near_duplicates(retold(spark, sf_dir)))
    return pairs.withColumnRenamed("source", "source_table")


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.with_links(*near_duplicates.near_duplicates(retold(spark, sf_dir)))


def memory_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    memories = one_per_id(table(spark, sf_dir, "memories"), DIM, "namespace")
    options = table(spark, sf_dir, "dream_options").select("namespace", F.col("cluster_threshold").alias("threshold"))
    return clusters.clusters(memories, DIM, options)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory_clusters(spark, sf_dir).select(F.col("id").alias("memory_id"), "cluster_id")


def p2_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.described(materialize(memory_clusters(spark, sf_dir), "members"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    observations = one_per_id(table(spark, sf_dir, "observations"), DIM)
    return neighbours.similar_pairs(neighbours.nearest(observations, DIM, 5, least=0.75))


def p4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(one_per_id(table(spark, sf_dir, "observations"), DIM), DIM, 5)


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_column(table(spark, sf_dir, "documents"), "doc_id", "text")


def p6_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.decode_column(p6_ids(spark, sf_dir), "doc_id")


def packed_documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, int]]:
    targets = table(spark, sf_dir, "pack_targets").collect()  # a fixed configuration of three rows
    documents = table(spark, sf_dir, "documents")
    parts, capacities = [], {}
    for name in sorted({t.tokenizer for t in targets}):
        own = {t.target: t.capacity_tokens for t in targets if t.tokenizer == name}
        sizes = tokens.count_column(documents, "doc_id", "text", name).select(F.col("doc_id").alias("id"), F.col("n_tokens").alias("size"))
        parts.append(packing.pack(sizes, own))
        capacities |= own
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out, capacities


def p7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(spark, sf_dir)[0].withColumnRenamed("id", "doc_id")


def p7_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.filling(*packed_documents(spark, sf_dir))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = materialize(skeleton.fingerprints(table(spark, sf_dir, "documents"), "doc_id", "text"), "prints")
    return skeleton.look_alike_pairs(prints).select(F.col("id_a").alias("doc_id_a"), F.col("id_b").alias("doc_id_b"))


def p8_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = materialize(skeleton.fingerprints(table(spark, sf_dir, "documents"), "doc_id", "text"), "prints")
    return skeleton.look_members(prints).withColumnRenamed("id", "doc_id")


def p8_skeletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skeleton.skeletons(table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES = {
    "p1_found": p1_found,
    "p1_classes": p1_classes,
    "p2_found": p2_found,
    "p2_clusters": p2_clusters,
    "p4_found": p4_found,
    "p4_nearest": p4_nearest,
    "p6_ids": p6_ids,
    "p6_decoded": p6_decoded,
    "p7_packing": p7_packing,
    "p7_filling": p7_filling,
    "p8_found": p8_found,
    "p8_classes": p8_classes,
    "p8_skeletons": p8_skeletons,
}

_WORDS = r"""
WITH texts AS (
  SELECT 'federation_results' AS source, result_id AS key, definition AS text FROM federation_results
  UNION SELECT 'threads', id, body FROM threads),
sets AS (SELECT source, key, list_sort(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))) AS words FROM texts),
kept AS (SELECT source, key, words, len(words) AS n FROM sets WHERE len(words) >= 8),
flat AS (SELECT source, key, words, n, unnest(words) AS word FROM kept),
pairs AS (
  SELECT a.source, a.key AS key_a, b.key AS key_b, a.words AS words_a, b.words AS words_b, count(*) / (any_value(a.n) + any_value(b.n) - count(*))::double AS likeness
  FROM flat a JOIN flat b ON a.source = b.source AND a.word = b.word AND a.key < b.key GROUP BY ALL)
"""
_VALID = "len(embedding) = 128 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
_CLUSTERS = f"""
WITH one AS (
  SELECT id, namespace, embedding::double[] AS v FROM memories WHERE {_VALID}
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) = 1),
links AS (
  SELECT a.id, b.id AS other FROM one a JOIN one b ON a.namespace = b.namespace
  LEFT JOIN dream_options o ON o.namespace = a.namespace
  WHERE list_cosine_similarity(a.v, b.v) >= coalesce(o.cluster_threshold, 0.7) OR a.id = b.id),
led AS (SELECT id AS memory_id, min(other) AS cluster_id, count(*) AS n FROM links GROUP BY id)
"""
_NEAREST = f"""
WITH one AS (
  SELECT id, embedding::double[] AS v FROM observations WHERE {_VALID}
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) = 1),
near AS (
  SELECT a.id, b.id AS other, list_cosine_similarity(a.v, b.v) AS score FROM one a JOIN one b ON a.id <> b.id
  QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY score DESC, b.id) <= 5)
"""


def look_sql() -> str:
    """looks AS (doc_id, text, look): the prototype of each character by `translate` and `replace`, composed at the end."""
    composed = lambda c: unicodedata.normalize("NFC", skeleton.skeleton(c))
    table = {c: to for code in range(0x80, sys.maxunicode + 1) if not 0xD800 <= code < 0xE000 and (to := composed(c := chr(code))) != unicodedata.normalize("NFC", c)}
    chars = lambda codes: f"list_aggregate(list_transform([{', '.join(map(str, codes))}], lambda x: chr(x)), 'string_agg', '')"
    one, gone = {c: to for c, to in table.items() if len(to) == 1}, [ord(c) for c, to in table.items() if not to]
    look = f"translate(text, {chars([*map(ord, one), *gone])}, {chars(map(ord, one.values()))})"
    for c, to in table.items():
        if len(to) > 1:
            look = f"replace({look}, chr({ord(c)}), {' || '.join(f'chr({ord(x)})' for x in to)})"
    return f"looks AS (SELECT doc_id, text, nfc_normalize({look}) AS look FROM documents WHERE text IS NOT NULL)"


_BLANK = " || ".join(f"chr({c})" for c in (9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 8232, 8233))
_LOOKS = f"WITH {look_sql()}, seen AS (SELECT doc_id, text, look FROM looks WHERE translate(look, {_BLANK}, '') <> '') "
_CLASSES = _WORDS.split("flat AS")[0].rstrip().rstrip(",") + """,
classes AS (SELECT source, words, md5(array_to_string(words, ' ')) AS c, len(words) AS n, min(key) AS class_id, count(DISTINCT key) AS n_copies FROM kept WHERE key IS NOT NULL GROUP BY source, words),
flat AS (SELECT source, c, n, unnest(words) AS word FROM classes),
likes AS (SELECT a.source, a.c AS a, b.c AS b FROM flat a JOIN flat b ON a.source = b.source AND a.word = b.word AND a.c < b.c GROUP BY a.source, a.c, b.c HAVING count(*) / (any_value(a.n) + any_value(b.n) - count(*))::double >= 0.7),
ends AS (SELECT source, c, count(*) AS n_links FROM (SELECT source, a AS c FROM likes UNION ALL SELECT source, b FROM likes) GROUP BY ALL)
"""
ORACLE = {
    "p1_classes": _CLASSES + "SELECT DISTINCT k.source, k.key, class_id, n_copies, coalesce(n_links, 0) AS n_links FROM kept k JOIN classes USING (source, words) LEFT JOIN ends USING (source, c)",
    "p8_found": _LOOKS + "SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM seen a JOIN seen b ON a.look = b.look AND a.doc_id < b.doc_id AND a.text <> b.text",
    "p8_classes": _LOOKS
    + """, t AS (SELECT look, text, min(doc_id) AS text_id, count(*) AS n FROM seen GROUP BY ALL),
l AS (SELECT look, count(*) AS n_texts, sum(n)::bigint AS n_rows, min(text_id) AS class_id FROM t GROUP BY look HAVING count(*) > 1)
SELECT doc_id, class_id, text_id, n_texts, n_rows FROM seen JOIN t USING (look, text) JOIN l USING (look)""",
    "p2_found": _CLUSTERS + "SELECT memory_id, cluster_id FROM led WHERE n > 1",
    "p4_found": _NEAREST + "SELECT DISTINCT least(id, other) AS id_a, greatest(id, other) AS id_b FROM near WHERE score >= 0.75",
    "p1_found": _WORDS + "SELECT DISTINCT source AS source_table, key_a, key_b FROM pairs WHERE likeness >= 0.7",
    "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
