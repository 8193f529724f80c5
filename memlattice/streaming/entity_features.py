"""Per-entity feature rows from an event stream: counters and latest times for each event type.

Events are delivered several times; of one event only the delivery with the latest `version` counts. Two streams, each
with its own checkpoint, follow one another:

1. `Deliveries` keeps the counted delivery of every event in RocksDB state, sharded by event id, so that a hot entity is
   spread over all shards. A shard's records lie in pages (map state), of which a batch reads and writes only those that
   it touches. What a delivery changes goes to a log: +1 for a new event, -old and +new for one that is delivered again.
2. A streaming aggregation keeps the counters and the latest time of each (entity, type) as state; changes are added up
   within each task before they are sent. After each batch the full feature rows of the touched entities are upserted
   into a table of hash buckets of the entity.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from memlattice.tables import key, shared_dir, subfolders

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NO_TIME = -1
COLUMNS = ["trace_id", "session_id", "tool_used", "retry_within_60s", "timestamp", "ingested_at"]
HELD = "h1 array<bigint>, h2 array<bigint>, version array<bigint>, entity array<string>, type array<string>, flag array<boolean>, at_ms array<bigint>"
CHANGES = "entity string, type string, n bigint, n_flagged bigint, at_ms bigint, lost_ms bigint"
ROWS = "entity string, n_events bigint, n_flagged bigint, last_ms bigint, n_types bigint, features array<struct<type: string, n: bigint, flagged: bigint, last: bigint>>"
#: A page of the delivery state holds about this many events.
PAGE_EVENTS = 128


def named(column: Column | str) -> Column:
    """The normal form of an entity or type; null and blank become `unknown`."""
    return F.coalesce(F.nullif(key(column), F.lit("")), F.lit("unknown"))


def events(traces: DataFrame, shards: int, pages: int) -> DataFrame:
    """Retrieval traces as events. Without a trace_id a row is its own event (repeats of it, in the columns that are
    read, are one). Other columns are not read."""
    own = F.when(F.col("trace_id").isNull(), F.struct("session_id", "tool_used", "retry_within_60s", "timestamp", "ingested_at"))
    return traces.select(
        F.xxhash64("trace_id", own).alias("h1"),
        F.xxhash64(F.lit("second"), "trace_id", own).alias("h2"),
        F.coalesce(F.unix_micros("ingested_at"), F.lit(-(2**62))).alias("version"),
        named("session_id").alias("entity"),
        named("tool_used").alias("type"),
        F.coalesce("retry_within_60s", F.lit(False)).alias("flag"),
        F.coalesce(F.unix_millis("timestamp"), F.lit(NO_TIME)).alias("at_ms"),
    ).withColumns({"shard": F.pmod("h1", F.lit(shards)).cast("int"), "page": F.pmod("h2", F.lit(pages)).cast("int")})


def order(record: tuple) -> tuple:
    """Of several deliveries of an event the greatest counts: the latest version, then ties by content."""
    version, entity, kind, flag, at = record
    return version, at, flag, entity, kind


class Deliveries(StatefulProcessor):
    """The counted delivery of each event of a shard, in pages; emits what each delivery changes.

    lost_ms is the time of an event that left a cell (null if it had none): the cell's latest time may be gone.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("held", "page int", HELD)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: ARG002
        for chunk in rows:
            pages: dict[int, list[tuple]] = {}
            for r in zip(*(chunk[c].tolist() for c in ("page", "h1", "h2", "version", "entity", "type", "flag", "at_ms")), strict=True):
                pages.setdefault(r[0], []).append(r[1:])
            out: list[tuple] = []
            for page, new in pages.items():
                held = self.held.getValue((page,))
                columns = [list(c) for c in held] if held else [[] for _ in range(7)]
                place = {event: i for i, event in enumerate(zip(columns[0], columns[1], strict=True))}
                before: dict[int, tuple | None] = {}
                for r in new:
                    at = place.get(r[:2])
                    if at is None:
                        place[r[:2]] = at = len(columns[0])
                        before[at] = None
                        for c, x in zip(columns, r, strict=True):
                            c.append(x)
                        continue
                    old = tuple(c[at] for c in columns[2:])
                    before.setdefault(at, old)
                    if order(r[2:]) > order(old):
                        for c, x in zip(columns[2:], r[2:], strict=True):
                            c[at] = x
                for at, old in before.items():
                    out += changes(old, tuple(c[at] for c in columns[2:]))
                self.held.updateValue((page,), tuple(columns))
            yield pd.DataFrame(out, columns=["entity", "type", "n", "n_flagged", "at_ms", "lost_ms"]).astype({"at_ms": "Int64", "lost_ms": "Int64"})

    def close(self) -> None:
        pass


def changes(old: tuple | None, new: tuple) -> list[tuple]:
    """entity, type, n, n_flagged, at_ms, lost_ms of what one event's new record changes."""
    _, entity, kind, flag, at = new
    if old is None:
        return [(entity, kind, 1, int(flag), at, None)]
    _, *cell, was, then = old
    if (*cell, then) == (entity, kind, at):
        return [] if was == flag else [(entity, kind, 0, int(flag) - int(was), None, None)]
    return [(*cell, -1, -int(was), None, then if then != NO_TIME else None), (entity, kind, 1, int(flag), at, None)]


def newest(spark: SparkSession, path: str, before: float = math.inf) -> dict[str, str]:
    """The folder of each bucket's newest epoch before the given one."""
    out = {}
    for bucket in subfolders(spark, path, "bucket="):
        epochs = [int(e.split("=")[1]) for e in subfolders(spark, f"{path}/{bucket}", "epoch=")]
        if held := [e for e in epochs if e < before]:
            out[bucket] = f"{path}/{bucket}/epoch={max(held)}"
    return out


def feature_table(spark: SparkSession, path: str, folders: dict[str, str] | None = None) -> DataFrame:
    """The feature rows of each bucket's newest epoch: one row an entity with at least one event."""
    folders = newest(spark, path) if folders is None else folders
    if not folders:
        return spark.createDataFrame([], f"{ROWS}, bucket int, epoch bigint")
    return spark.read.schema(f"{ROWS}, bucket int, epoch bigint").option("basePath", path).parquet(*folders.values())


def upsert(cells: DataFrame, epoch: int, home: str, buckets: int) -> None:
    """Writes the touched buckets anew as this epoch's, with full rows; writing them twice gives the same. cells: the
    counters of the touched (entity, type), as state has them."""
    spark, path = cells.sparkSession, f"{home}/features"
    cells = cells.withColumn("bucket", F.pmod(F.xxhash64("entity"), F.lit(buckets)).cast("int"))
    cells.write.mode("overwrite").parquet(f"{home}/touched/{epoch}")  # computed once; survives lost executors
    cells = spark.read.schema(cells.schema).parquet(f"{home}/touched/{epoch}")
    doubt = F.expr("coalesce(lost >= last and n > 0, false)")  # the event with the latest time has left
    found = cells.groupBy("bucket").agg(F.bool_or(doubt).alias("doubt")).collect()  # at most `buckets` rows
    if any(r.doubt for r in found):  # the latest of those that are still there
        doubtful = cells.where(doubt).select("entity", "type")
        log = spark.read.schema(CHANGES).parquet(f"{home}/changes").join(doubtful, ["entity", "type"], "left_semi")
        there = log.groupBy("entity", "type", F.coalesce("at_ms", "lost_ms").alias("at")).agg(F.sum("n").alias("n")).where("n > 0")
        mended = there.groupBy("entity", "type").agg(F.max("at").alias("mended"), F.lit(True).alias("was_mended"))
        cells = cells.join(mended, ["entity", "type"], "left").withColumn("last", F.when(F.col("was_mended"), F.coalesce("mended", F.lit(NO_TIME))).otherwise(F.col("last"))).drop("mended", "was_mended")
    earlier = newest(spark, path, epoch)
    touched = {f"bucket={r.bucket}" for r in found}
    old = feature_table(spark, path, {b: f for b, f in earlier.items() if b in touched}).select("bucket", "entity", F.explode("features").alias("f"))
    both = cells.select("bucket", "entity", "type", "n", F.col("n_flagged").alias("flagged"), F.coalesce("last", F.lit(NO_TIME)).cast("bigint").alias("last"), F.lit(1).alias("new"))
    both = both.unionByName(old.select("bucket", "entity", "f.*", F.lit(0).alias("new")))
    kept = both.groupBy("bucket", "entity", "type").agg(F.max_by(F.struct("n", "flagged", "last"), "new").alias("c")).select("bucket", "entity", "type", "c.*").where("n > 0")
    rows = feature_rows(kept.withColumnsRenamed({"flagged": "n_flagged", "last": "last_ms"}), "bucket")
    rows = rows.withColumn("epoch", F.lit(epoch).cast("bigint")).repartition("bucket").sortWithinPartitions("bucket")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "epoch").parquet(path)
    for bucket in touched & earlier.keys():  # what neither a reader of the last epoch nor a batch that is run again needs
        for e in subfolders(spark, f"{path}/{bucket}", "epoch="):
            if int(e.split("=")[1]) < int(earlier[bucket].split("=")[-1]):
                old_path = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{bucket}/{e}")
                old_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old_path, True)


def source(spark: SparkSession, path: str, bytes_per_batch: int) -> DataFrame:
    """A stream over a Parquet file or folder, in batches of about the given size."""
    schema = spark.read.parquet(path).schema
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema).option("maxBytesPerTrigger", bytes_per_batch)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop).isFile():
        return reader.option("pathGlobFilter", hadoop.getName()).parquet(str(hadoop.getParent()))
    return reader.parquet(path)


def run_features(stream: DataFrame, home: str, shards: int = 64, buckets: int = 16, pages: int = 64) -> str:
    """Drains the stream into the feature table below `home` and returns the table's path; run again over a longer
    input with the same `home`, it goes on from the checkpoints. shards, pages (of a shard) and buckets are fixed when
    the checkpoints begin: a page should come to hold some hundred events, a bucket what a few tasks write."""
    spark = stream.sparkSession
    # RocksDB, of which a batch uploads only what it changed
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    ntz = {c: F.col(c).cast("timestamp") for c, kind in stream.dtypes if kind == "timestamp_ntz"}
    made = spark._jvm.org.apache.hadoop.fs.Path(f"{home}/changes")
    made.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(made)

    def run(df: DataFrame, name: str, each) -> None:
        query = df.writeStream.outputMode("update").option("checkpointLocation", f"{home}/checkpoint_{name}").foreachBatch(each).trigger(availableNow=True).start()
        query.awaitTermination()

    try:
        told = events(stream.withColumns(ntz) if ntz else stream, shards, pages).groupBy("shard").transformWithStateInPandas(Deliveries(), CHANGES, "Update", "None")
        run(told, "deliveries", lambda df, epoch: df.write.mode("overwrite").parquet(f"{home}/changes/epoch={epoch}"))
        per_epoch = int(spark.conf.get("spark.sql.shuffle.partitions"))  # files that an epoch of changes has at most
        changed = spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", per_epoch).parquet(f"{home}/changes")
        cells = changed.groupBy("entity", "type").agg(F.sum("n").alias("n"), F.sum("n_flagged").alias("n_flagged"), F.max("at_ms").alias("last"), F.max("lost_ms").alias("lost"))
        run(cells, "counters", lambda df, epoch: upsert(df, epoch, home, buckets))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    return f"{home}/features"


def feature_cells(spark: SparkSession, path: str) -> DataFrame:
    """entity, type, n, n_flagged, last_ms (-1: no event has a time) for each type with at least one event."""
    return feature_table(spark, path).select("entity", F.explode("features").alias("f")).select("entity", "f.type", "f.n", F.col("f.flagged").alias("n_flagged"), F.col("f.last").alias("last_ms"))


def feature_rows(cells: DataFrame, *also: str) -> DataFrame:
    """One row an entity: totals, recency, and its types as an array sorted by name (at most one element a type)."""
    return cells.groupBy(*also, "entity").agg(
        F.sum("n").alias("n_events"),
        F.sum("n_flagged").alias("n_flagged"),
        F.max("last_ms").alias("last_ms"),
        F.count("*").alias("n_types"),
        F.array_sort(F.collect_list(F.struct("type", "n", F.col("n_flagged").alias("flagged"), F.col("last_ms").alias("last")))).alias("features"),
    )


def traces_features(spark: SparkSession, path: str, batches: int = 4, shards: int = 64) -> str:
    """The feature table's path of a table of retrieval traces that arrives in `batches` batches of files. A table of
    few files is landed first, as files of the columns that are read, in the order of its rows."""
    home, traces = shared_dir(spark), spark.read.parquet(path).select(*COLUMNS)
    n = traces.count()
    traces.write.option("maxRecordsPerFile", max(1, math.ceil(n / batches))).option("compression", "zstd").parquet(f"{home}/arrivals")
    files = len(subfolders(spark, f"{home}/arrivals", "part-"))
    stream = spark.readStream.schema(traces.schema).option("maxFilesPerTrigger", max(1, math.ceil(files / batches))).parquet(f"{home}/arrivals")
    return run_features(stream, home, shards, pages=max(1, math.ceil(n / shards / PAGE_EVENTS)))
