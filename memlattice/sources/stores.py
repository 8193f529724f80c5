"""Stores of typed tables under one address, with versioned snapshots, JSON and Markdown sources, and migration."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from urllib.parse import parse_qs, urlsplit

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlattice.operators.filters import diff, upsert

NAME = re.compile(r"[a-zA-Z0-9_]+")


@dataclass(frozen=True)
class Store:
    """Tables below a folder; each write is a new version, which readers see when its success marker is there."""

    spark: SparkSession
    kind: str
    path: str
    namespace: str | None = None

    def folder(self, table: str) -> str:
        if not NAME.fullmatch(table):
            raise ValueError(f"no name of a table: {table}")
        return f"{self.path}/{self.namespace + '_' if self.namespace else ''}{table}"

    def versions(self, table: str) -> list[int]:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder(table))
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return []
        done = [s.getPath() for s in fs.listStatus(folder) if s.isDirectory() and s.getPath().getName().startswith("v=")]
        return sorted(int(p.getName()[2:]) for p in done if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def read(self, table: str) -> DataFrame:
        """The newest version of a table."""
        versions = self.versions(table)
        if not versions:
            raise FileNotFoundError(self.folder(table))
        return self.spark.read.format(self.kind).load(f"{self.folder(table)}/v={versions[-1]}")

    def write(self, table: str, df: DataFrame) -> int:
        """df as the table's next version; its number. A version is never overwritten."""
        version = (self.versions(table) or [0])[-1] + 1
        df.write.format(self.kind).mode("errorifexists").save(f"{self.folder(table)}/v={version}")
        return version

    def upsert(self, table: str, changes: DataFrame, id_column: str = "id") -> int:
        return self.write(table, upsert(self.read(table), changes, id_column) if self.versions(table) else changes)


def connect(spark: SparkSession, address: str) -> Store:
    """`parquet:/folder?namespace=x` or `json:/folder`."""
    parts = urlsplit(address)
    if parts.scheme not in ("parquet", "json", "orc"):
        raise ValueError(f"no such kind of store: {parts.scheme}")
    namespace = parse_qs(parts.query).get("namespace", [None])[0]
    if namespace is not None and not NAME.fullmatch(namespace):
        raise ValueError(f"no name of a namespace: {namespace}")
    return Store(spark, parts.scheme, parts.path, namespace)


def refused(source: DataFrame, target: DataFrame | None) -> str | None:
    """Why a table may not be copied: other columns, or embeddings of another length than those that are there."""
    if target is None:
        return None
    if set(source.columns) != set(target.columns):
        return "other columns"
    if "embedding" in source.columns:
        size = lambda df: df.where(F.size("embedding") > 0).groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
        left, right = size(source), size(target)
        if left and right and left[0].n != right[0].n:
            return "embeddings of another length"
    return None


def migrate(source: Store, target: Store, tables: list[str], namespace: str | None = None) -> DataFrame:
    """Copies tables that the target does not have yet, under another namespace if one is given, and compares every row
    of all of them: kind, n_left, n_right, only_left, only_right. A run that broke off goes on with the first table that
    has no complete version. A table that is there must have the same columns and length of embeddings."""
    target = target if namespace is None else Store(target.spark, target.kind, target.path, namespace)
    for t in tables:
        if why := refused(source.read(t), target.read(t) if target.versions(t) else None):
            raise ValueError(f"{t}: {why}")
    report = None
    for t in tables:
        if not target.versions(t):
            target.write(t, source.read(t))
        one = diff(source.read(t), target.read(t), t)
        report = one if report is None else report.unionByName(one)
    return report


def capabilities(memories: DataFrame) -> DataFrame:
    """schema_version, dimension of the embeddings (the commonest), the categories."""
    size = memories.where(F.size("embedding") > 0).groupBy(F.size("embedding").alias("dimension")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dimension").limit(1)
    names = memories.agg(F.array_sort(F.collect_set("category")).alias("categories"))  # a fixed set of names
    return names.crossJoin(size.select("dimension")).select(F.lit(1).alias("schema_version"), "dimension", "categories")  # one row each


def front_matter(text: str | None) -> str | None:
    """The YAML block at the head of a document, as JSON; None if there is none or it is malformed."""
    found = re.match(r"---\r?\n(.*?)\r?\n---\r?\n?", text or "", re.S)
    try:
        data = yaml.safe_load(found[1]) if found else None
    except yaml.YAMLError:
        data = None
    return json.dumps(data, default=str) if isinstance(data, dict) else None


def read_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """path, meta (map of the front matter, empty if there is none), body of each .md file below a folder; hidden,
    node_modules and _trash folders are left out."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    files = files.select(F.input_file_name().alias("path"), F.col("value").alias("text")).where(~F.col("path").rlike(r"/(?:\.[^/]*|node_modules|_trash)/"))
    meta = F.pandas_udf(lambda s: s.map(front_matter), "string")
    parsed = files.withColumn("meta", F.from_json(meta("text"), "map<string,string>"))
    return parsed.select("path", F.coalesce("meta", F.create_map().cast("map<string,string>")).alias("meta"), F.regexp_replace("text", r"(?s)\A---\r?\n.*?\r?\n---\r?\n?", "").alias("body"))


def pending_digests(files: DataFrame) -> DataFrame:
    """Files whose front matter asks for a digest that isn't done."""
    return files.where((F.col("meta")["directive"] == "digest") & F.coalesce(F.col("meta")["status"], F.lit("pending")).isin("active", "pending"))
