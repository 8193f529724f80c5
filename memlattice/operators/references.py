"""References to records that do not exist: range-partitioned parents probed by binary search.

Parents are reduced to one row a key and range-partitioned, so that each range holds at most about `range_rows` keys.
Only the lower bound of each range goes to the driver (one key a range). References find their range by these bounds;
a range that many references fall into is probed in several salted batches, to each of which the range's parents are
copied, so that one key with a third of all references is spread over many tasks. A range is stored as one row of sorted
arrays, which is what a batch gets; all its references are looked up at once by binary search.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlattice.tables import key, materialize

#: Between field and key in the sorted arrays; it can't be part of a trimmed key's field.
SEP = "\x1f"


def parent_keys(targets: DataFrame, tombstones: DataFrame) -> DataFrame:
    """One row a (ref_field, parent): whether it is there, its earliest time, whether it was deleted.

    targets: ref_field, parent, created_at. tombstones: ref_field, parent. Null and blank keys are no parents.
    """
    live = targets.select("ref_field", key("parent").alias("parent"), "created_at", F.lit(True).alias("live"))
    dead = tombstones.select("ref_field", key("parent").alias("parent"), F.lit(None).cast("timestamp").alias("created_at"), F.lit(False).alias("live"))
    return (
        live.unionByName(dead)
        .where(F.length("parent") > 0)
        .groupBy(F.concat("ref_field", F.lit(SEP), "parent").alias("k"))
        .agg(F.max("live").alias("live"), F.min("created_at").alias("first_at"), F.max(~F.col("live")).alias("deleted"))
    )


def orphan_references(refs: DataFrame, targets: DataFrame, tombstones: DataFrame, range_rows: int = 200_000, batch_rows: int = 200_000) -> DataFrame:
    """Each orphan reference once: owner_id, ref_field, ref_value, seen_at, reason.

    refs: owner_id, ref_field, ref_value, seen_at. Null and blank references are none; references without seen_at are
    never late, nor are those whose target has no time. reason is `missing` (neither target nor tombstone), `deleted`
    (only a tombstone) or `late` (the earliest target is after seen_at). Other columns are not read.
    """
    parents = parent_keys(targets, tombstones)
    parents = materialize(parents, "parents")
    n_ranges = max(1, math.ceil(parents.count() / range_rows))
    parents = materialize(parents.repartitionByRange(n_ranges, "k").withColumn("range", F.spark_partition_id()), "ranges")
    sorted_ = F.array_sort(F.collect_list(F.struct("k", "live", "deleted", F.unix_micros("first_at").alias("first"))))  # about range_rows keys, by the partitioning
    stored = parents.groupBy("range").agg(sorted_.alias("a")).select("range", "a.k", "a.live", "a.deleted", "a.first")
    parents = materialize(stored, "arrays")
    lows = parents.select("range", F.col("k")[0].alias("low")).orderBy("low").collect()  # one row a range
    bounds, ranges = [r.low for r in lows], [r.range for r in lows]

    @F.pandas_udf("int")
    def range_of(k: pd.Series) -> pd.Series:
        at = np.searchsorted(np.array(bounds, dtype=object), k.to_numpy(dtype=object), side="right") - 1
        return pd.Series(np.array(ranges, dtype=np.int32)[np.maximum(at, 0)] if bounds else np.zeros(len(k), np.int32))

    asked = (
        refs.select("owner_id", "ref_field", key("ref_value").alias("ref_value"), "seen_at")
        .where(F.length("ref_value") > 0)
        .distinct()
        .withColumn("k", F.concat("ref_field", F.lit(SEP), "ref_value"))
    )
    asked = materialize(asked.withColumn("range", range_of("k") if len(bounds) > 1 else F.lit(ranges[0] if ranges else 0)), "references")
    batches = asked.groupBy("range").agg(F.ceil(F.count("*") / batch_rows).cast("int").alias("batches"))
    salted = asked.join(F.broadcast(batches), "range").withColumn("salt", F.pmod(F.xxhash64("owner_id", "k"), F.col("batches")).cast("int")).drop("batches")
    copies = parents.join(F.broadcast(batches), "range").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("batches") - 1))).drop("batches")

    def probe(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        asked = asked.sort_values("k", kind="stable", ignore_index=True)
        k = asked.k.to_numpy(dtype=object)
        keys, live, deleted, first = (np.asarray(held[c].iloc[0]) if len(held) else np.empty(0) for c in ("k", "live", "deleted", "first"))
        at = np.searchsorted(keys, k) if len(keys) else np.zeros(len(k), int)
        known = np.zeros(len(k), bool)
        inside = at < len(keys)
        known[inside] = keys[at[inside]] == k[inside]
        of = lambda a, none: np.where(known, a[np.where(known, at, 0)], none) if len(a) else np.full(len(k), none)
        live, deleted = of(live, False).astype(bool), of(deleted, False).astype(bool)
        first = pd.to_datetime(pd.Series(of(first, None), dtype=object).astype("Int64"), unit="us")
        late = live & (first > pd.to_datetime(asked.seen_at).astype("datetime64[us]")).fillna(False).to_numpy(dtype=bool)
        asked["reason"] = np.select([~live & deleted, ~live, late], ["deleted", "missing", "late"], "")
        return asked.loc[asked.reason != "", ["owner_id", "ref_field", "ref_value", "seen_at", "reason"]]

    return (
        salted.groupBy("range", "salt")
        .cogroup(copies.groupBy("range", "salt"))
        .applyInPandas(probe, "owner_id string, ref_field string, ref_value string, seen_at timestamp, reason string")
    )


def orphans_by_month(orphans: DataFrame) -> DataFrame:
    """Number of orphan references and of their owners a field, reason and month of seen_at (null: no time)."""
    return orphans.groupBy("ref_field", F.date_format(F.date_trunc("month", "seen_at"), "yyyy-MM").alias("month"), "reason").agg(
        F.count_distinct("owner_id", "ref_value").alias("n_references"), F.count_distinct("owner_id").alias("n_owners")
    )
