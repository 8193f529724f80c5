"""Filling containers of fixed capacity: minimum bin slack over the table of item lengths.

Items longer than a container are cut into full pieces and a rest; all others stay whole. How the lengths combine depends
only on how many items have each length, so the search works on that table: at most `capacity` rows a target, however
many items there are. Each container takes the longest length that is left and the fullest combination of others that
fits, found by a subset-sum dynamic program whose reachable sums are the bits of one integer. A combination is used as
often as its lengths last, which is what repeating the search would give.

A target's lengths are dealt to shards by their hash, some hundred to a shard, and each shard is searched by a task of
its own; of what it finds only the containers without any slack are kept. What is left of all shards, a small rest, is
searched once more together. Spark then numbers the items of each length (in salted parts, so that no length is one
task's) and joins them with the slots of the combinations. Both the counts of the salted parts and the slots in blocks
grow with the items, and their files say too little of their size in memory; so neither is ever sent to all executors.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memlattice.tables import materialize

BLOCK = 1024
#: Lengths of a shard, about.
SHARD_LENGTHS = 256
#: Items of one salt, about, if all had one length.
SALT_ROWS = 100_000


def fullest(lengths: list[int], left: dict[int, int], room: int) -> dict[int, int]:
    """The combination of items, at most left[n] of length n, whose sum is the largest that is at most room; of equal
    sums that which uses long items. lengths: descending."""
    mask, sums, steps = (1 << (room + 1)) - 1, 1, []
    for n in lengths:
        if n > room or not left[n]:
            continue
        steps.append((n, sums))
        copies, power = min(left[n], room // n), 1
        while copies > 0:
            taken = min(power, copies)
            sums |= sums << (n * taken) & mask
            copies -= taken
            power *= 2
        if sums >> room & 1:
            break
    total, used = sums.bit_length() - 1, {}
    for n, before in reversed(steps):
        count = 0
        while not before >> total & 1:
            total -= n
            count += 1
        if count:
            used[n] = count
    return used


def combinations(lengths: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(times, {length: items a container}) until no item is left."""
    left, out = dict(lengths), []
    order = sorted(left, reverse=True)
    for longest in order:
        while left[longest]:
            left[longest] -= 1
            used = fullest(order, left, capacity - longest)
            left[longest] += 1
            used[longest] = used.get(longest, 0) + 1
            times = min(left[n] // c for n, c in used.items())
            for n, c in used.items():
                left[n] -= c * times
            out.append((times, used))
    return out


def slots_of(capacities: dict[str, int], last: bool) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """Searches a table of lengths (size_, n items from rank `first` on). Containers are numbered within the group; but
    for the last search, items of containers with slack come out as a rest (without a container)."""

    def slots(group: tuple, table: pd.DataFrame) -> pd.DataFrame:
        target, shard = group[0], group[1]
        rows, container, ranks = [], 0, dict(zip(table.size_.tolist(), table["first"].tolist(), strict=True))
        ends = dict(zip(table.size_.tolist(), (table["first"] + table.n).tolist(), strict=True))
        for times, used in combinations(dict(zip(table.size_.tolist(), table.n.tolist(), strict=True)), capacities[target]):
            if not last and sum(n * c for n, c in used.items()) < capacities[target]:
                continue
            for n, count in used.items():
                rows.append((target, shard, n, ranks[n], ranks[n] + count * times, container, count))
                ranks[n] += count * times
            container += times
        rows += [(target, shard, n, at, ends[n], None, None) for n, at in ranks.items() if at < ends[n]]
        out = pd.DataFrame(rows, columns=["target", "shard", "size_", "rank_from", "rank_to", "container", "each"])
        return out.astype({"container": "Int64", "each": "Int64"})

    return slots


def searched(lengths: DataFrame, capacities: dict[str, int]) -> DataFrame:
    """target, size_, rank_from, rank_to, container, each: which items of a length go to which containers. The k-th item
    from rank_from on goes to container + k // each. lengths: target, size_, n."""
    kind = "target string, shard int, size_ bigint, rank_from bigint, rank_to bigint, container bigint, each bigint"
    shards = lengths.groupBy("target").agg(F.ceil(F.count("*") / SHARD_LENGTHS).cast("int").alias("shards"))  # one row a target
    dealt = lengths.join(F.broadcast(shards), "target").select("target", "size_", "n", F.lit(0).cast("bigint").alias("first"), F.pmod(F.xxhash64("size_"), F.col("shards")).cast("int").alias("shard"))
    first = materialize(dealt.groupBy("target", "shard").applyInPandas(slots_of(capacities, False), kind), "shards")
    full = first.where("container is not null")
    rest = first.where("container is null").select("target", "size_", F.col("rank_from").alias("first"), (F.col("rank_to") - F.col("rank_from")).alias("n"), F.lit(-1).alias("shard"))
    second = materialize(rest.groupBy("target", "shard").applyInPandas(slots_of(capacities, True), kind), "rest")
    both = full.unionByName(second)
    used = F.max(F.col("container") + F.floor((F.col("rank_to") - F.col("rank_from")) / F.col("each"))).alias("used")
    before = Window.partitionBy("target").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    starts = both.groupBy("target", "shard").agg(used).select("target", "shard", F.coalesce(F.sum("used").over(before), F.lit(0)).alias("start"))
    return both.join(F.broadcast(starts), ["target", "shard"]).select("target", "size_", "rank_from", "rank_to", (F.col("container") + F.col("start")).alias("container"), "each")


def pack(sizes: DataFrame, capacities: dict[str, int]) -> DataFrame:
    """target, container, id, piece, offset, size of each piece of each item, for each target's capacity.

    sizes: id (unique), size. Items of size 0 or null need no room: they come out with a null container and size 0.
    Containers of a target are numbered from 0. capacities: a fixed configuration of a few targets, each 1 or more.
    """
    targets = F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.lit(c).cast("bigint").alias("capacity")) for t, c in capacities.items()])).alias("t")
    whole = materialize(sizes.select("id", F.coalesce(F.col("size").cast("bigint"), F.lit(0)).alias("size")), "sizes")
    salts = max(64, math.ceil(whole.count() / SALT_ROWS))
    pieces = (
        whole.where("size > 0")
        .select("id", "size", targets)
        .select("t.target", "t.capacity", "id", "size", F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / F.col("t.capacity")).cast("int"))).alias("piece"))
        .withColumn("offset", F.col("piece") * F.col("capacity"))
        .select("target", "id", "piece", "offset", F.least("capacity", F.col("size") - F.col("offset")).alias("size_"), F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt"))
    )
    counts = materialize(pieces.groupBy("target", "size_", "salt").agg(F.count("*").alias("n")), "counts")
    earlier = Window.partitionBy("target", "size_").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("start", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    lengths = counts.groupBy("target", "size_").agg(F.sum("n").alias("n"))
    slots = materialize(searched(lengths, capacities), "slots").withColumn("block", F.explode(F.sequence(F.floor(F.col("rank_from") / BLOCK), F.floor((F.col("rank_to") - 1) / BLOCK))))

    in_salt = Window.partitionBy("target", "size_", "salt").orderBy("id", "piece")
    ranked = (
        pieces.withColumn("nth", F.row_number().over(in_salt) - 1)
        .join(starts.hint("merge"), ["target", "size_", "salt"])  # partitioned and sorted by the window already
        .withColumn("rank", F.col("start") + F.col("nth"))
        .withColumn("block", F.floor(F.col("rank") / BLOCK))
    )
    placed = ranked.join(slots.hint("merge"), ["target", "size_", "block"]).where("rank >= rank_from and rank < rank_to")
    placed = placed.select("target", (F.col("container") + F.floor((F.col("rank") - F.col("rank_from")) / F.col("each"))).alias("container"), "id", "piece", "offset", F.col("size_").alias("size"))
    empty = whole.where("size = 0").select("id", "size", targets).select("t.target", F.lit(None).cast("bigint").alias("container"), "id", F.lit(0).alias("piece"), F.lit(0).cast("bigint").alias("offset"), "size")
    return placed.unionByName(empty)


def filling(packed: DataFrame, capacities: dict[str, int]) -> DataFrame:
    """Of each target: containers, pieces, tokens, the fewest containers that could hold them, and the share of unused
    space."""
    used = packed.where("container is not null")
    each = used.groupBy("target").agg(F.count_distinct("container").alias("n_containers"), F.count("*").alias("n_pieces"), F.sum("size").alias("n_tokens"))
    capacity = F.create_map(*[F.lit(x) for pair in capacities.items() for x in pair])[F.col("target")]
    return each.select("*", F.ceil(F.col("n_tokens") / capacity).alias("n_fewest"), (1 - F.col("n_tokens") / (F.col("n_containers") * capacity)).alias("unused"))
