"""Near-duplicate records: odd sketches of MinHash samples verify banded candidates, an exact count decides.

1. The distinct words of each text are hashed; texts with the same word set are one class, found by its 64-bit hash.
2. Each class gets `bands` x `band_rows` MinHash samples and an odd sketch: a bitmap in which every sample flips the bit
   that it hashes to. Two sketches' XOR has few bits where the sets are alike, and its population count gives the
   likeness.
3. Classes that share all samples of a band are candidates. Of them those with a sketch likeness below the limit less a
   margin leave, without reading their words.
4. For the rest the words are read again and counted exactly.

A task gives samples for the first of a class's copies only, so that a text with a third of all rows takes part in the
band join once a task, and once in all after the exchange.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlattice.tables import materialize

#: Two sets of likeness 0.74 share no band with a probability of 0.003, of 0.8 with 0.00003.
BANDS, BAND_ROWS, SKETCH_BITS = 44, 7, 512
#: A candidate leaves if its sketch likeness is this much below the limit: over five deviations of the estimate.
MARGIN = 0.2
#: A bucket of more classes is compared in parts; rows of a class are paired in pieces of about as many.
BUCKET_ROWS = 1000
#: Classes that a task remembers, so as not to sketch their copies; beyond that it starts afresh.
SEEN_CLASSES = 1_000_000
#: A word is a longest run of letters and digits of the lower-cased text.
WORD = re.compile(r"[^\W_]+")


class Words:
    """Sets of word hashes of texts; the memory of known words is bounded."""

    def __init__(self, most: int = 300_000):
        self.known: dict[str, int] = {}
        self.most = most

    def hashes(self, text: str | None) -> np.ndarray:
        """Sorted 64-bit hashes of the distinct words; none for a null text."""
        found = set(WORD.findall((text or "").lower()))
        if new := found.difference(self.known):
            if len(self.known) > self.most:
                self.known, new = {}, found
            self.known.update((w, xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))) for w in new)
        out = np.fromiter(map(self.known.__getitem__, found), np.uint64, len(found))
        out.sort()
        return out


def class_of(source: str, hashes: np.ndarray) -> int:
    """The signed 64-bit hash of a source's word set."""
    return xxhash.xxh3_64_intdigest(hashes.tobytes(), xxhash.xxh32_intdigest(source or "")) - 2**63


def samples(hashes: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """k MinHash samples of each set (rows of the result); the sets lie one after another, none is empty."""
    draw = np.random.default_rng(20240229)
    odd, add = draw.integers(1, 2**63, k, dtype=np.uint64) | np.uint64(1), draw.integers(1, 2**63, k, dtype=np.uint64)
    mixed = hashes.astype(np.uint64)
    mixed ^= mixed >> np.uint64(31)
    out = np.empty((len(starts), k), np.uint64)
    for i in range(k):
        out[:, i] = np.minimum.reduceat((mixed + add[i]) * odd[i], starts)
    return out


def odd_sketch(sample: np.ndarray, bits: int) -> np.ndarray:
    """The parity bitmap of each row of samples, as bytes."""
    place = (sample * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, sample.shape[1] + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(32)
    place = ((place * np.uint64(bits)) >> np.uint64(32)).astype(np.int64)
    flips = np.bincount((place + np.arange(len(sample))[:, None] * bits).ravel(), minlength=len(sample) * bits)
    return np.packbits((flips & 1).astype(np.uint8).reshape(len(sample), bits), axis=1)


def sketched(df: DataFrame, least_words: int, bands: int = BANDS, band_rows: int = BAND_ROWS, bits: int = SKETCH_BITS) -> DataFrame:
    """source, key, class (hash of the word set) of each row with enough words; for the first of a class in a task also
    bands (a hash each) and sketch (array of 64-bit words), null for the others. df: source, key, text."""
    k = bands * band_rows

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = Words(), set()
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                b = whole.slice(lo, 512)
                rows, classes, sets, at = [], [], [], []
                for i, (source, text) in enumerate(zip(b.column(0).to_pylist(), b.column(2), strict=True)):
                    hashes = words.hashes(text.as_py())
                    if len(hashes) < least_words:
                        continue
                    rows.append(i)
                    classes.append(class_of(source, hashes))
                    at.append(None if classes[-1] in seen else len(sets))
                    if at[-1] is not None:
                        if len(seen) >= SEEN_CLASSES:
                            seen.clear()
                        seen.add(classes[-1])
                        sets.append(hashes)
                band = parity = np.zeros((0, 1), np.int64)
                if sets:
                    starts = np.cumsum([0, *map(len, sets)])[:-1]
                    sample = samples(np.concatenate(sets), starts, k)
                    mix = sample.reshape(-1, bands, band_rows) * (np.arange(1, band_rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1))
                    band = ((mix ^ (mix >> np.uint64(29))).sum(axis=2, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                    parity = odd_sketch(sample, bits).view(np.int64)
                of = lambda m, kind: pa.array([None if j is None else m[j] for j in at], pa.list_(kind))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(rows, pa.int32())), b.column(1).take(pa.array(rows, pa.int32())), pa.array(classes, pa.int64()), of(band, pa.int32()), of(parity, pa.int64())],
                    names=["source", "key", "class", "bands", "sketch"],
                )

    kind = df.schema["key"].dataType.simpleString()
    return df.select("source", "key", "text").mapInArrow(sketch, f"source string, key {kind}, class bigint, bands array<int>, sketch array<bigint>")


def word_sets(df: DataFrame) -> DataFrame:
    """class and hashes of each row. df: source, class, text; rows whose text is no longer of that class are left out."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in batches:
            held = [(c, h) for s, c, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True) if class_of(s, h := words.hashes(t.as_py())) == c]
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in held], pa.int64()), pa.array([h.view(np.int64) for _, h in held], pa.list_(pa.int64()))], names=["class", "hashes"])

    return df.select("source", "class", "text").mapInArrow(sets, "class bigint, hashes array<bigint>")


def sketch_likeness(a: str, b: str, samples: int, bits: int) -> Column:
    """The likeness that the population count of the XOR of two sketches gives: 1 + n/4k ln(1 - 2|a xor b|/n)."""
    differ = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, n: s + n)
    return F.lit(1.0) + F.lit(bits / (4 * samples)) * F.log(F.greatest(F.lit(1e-9), 1 - differ * (2.0 / bits)))


def likeness(a: str, b: str) -> Column:
    """Shared by either, of two arrays of distinct hashes."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def bucket_pairs(keyed: DataFrame, most: int = BUCKET_ROWS) -> DataFrame:
    """class_a < class_b of each two rows (bucket, class, n) of a bucket of n rows. In a bucket of more than `most` rows
    the one side is cut into parts of about that size, to each of which the other is copied."""
    small, large = keyed.where(F.col("n") <= most), keyed.where(F.col("n") > most).withColumn("parts", F.ceil(F.col("n") / most).cast("int"))
    one = small.select("bucket", F.col("class").alias("class_a")).join(small.select("bucket", F.col("class").alias("class_b")), "bucket")
    part = large.select("bucket", F.col("class").alias("class_a"), F.pmod(F.xxhash64("class"), F.col("parts")).cast("int").alias("part"))
    copy = large.select("bucket", F.col("class").alias("class_b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    both = part.join(copy, ["bucket", "part"])
    return one.select("class_a", "class_b").unionByName(both.select("class_a", "class_b")).where("class_a < class_b")


def near_duplicates(df: DataFrame, limit: float = 0.7, least_words: int = 8, bands: int = BANDS, band_rows: int = BAND_ROWS, bits: int = SKETCH_BITS) -> tuple[DataFrame, DataFrame]:
    """Pairs of classes of one source with a likeness of `limit` or more, and the rows of each class.

    df: source, key, text. Returns (class_a < class_b, likeness) and (source, key, class). Null texts and texts with
    fewer than least_words distinct words are in no class, nor are rows whose key is null; whole repeats of a row are one. Pairs of a class with itself
    aren't given: its rows have likeness 1. Other columns are not read.
    """
    df = df.where("key is not null")
    docs = materialize(sketched(df, least_words, bands, band_rows, bits), "sketches")

    firsts = docs.where("bands is not null")
    # one row a class, whatever the number of tasks that met it: only then the bands are laid out
    one = firsts.groupBy("class").agg(F.min("source").alias("source"), F.min("bands").alias("bands"), F.min("sketch").alias("sketch"))
    one = materialize(one, "classes")
    bucketed = one.select("source", "class", F.posexplode("bands").alias("band", "value")).select(F.xxhash64("source", "band", "value").alias("bucket"), "class")
    counts = materialize(bucketed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "counts")
    keyed = materialize(bucketed.join(counts, "bucket"), "buckets")  # counts have a known size: sent to all while small
    pairs = bucket_pairs(keyed).distinct()
    sketches = one.select("class", "sketch")
    a, b = (sketches.select(F.col("class").alias(f"class_{s}"), F.col("sketch").alias(f"sketch_{s}")) for s in "ab")
    alike = pairs.join(a, "class_a").join(b, "class_b").where(sketch_likeness("sketch_a", "sketch_b", bands * band_rows, bits) >= limit - MARGIN)
    alike = materialize(alike.select("class_a", "class_b"), "candidates")

    asked = alike.select(F.explode(F.array("class_a", "class_b")).alias("class")).distinct()
    asked = materialize(firsts.join(asked, "class", "left_semi").groupBy("class").agg(F.min_by(F.struct("source", "key"), F.struct("source", "key")).alias("at")).select("class", "at.*"), "asked")
    found = df.select("source", "key", "text").join(asked, ["source", "key"])  # written, hence of a known size
    exact = word_sets(found).groupBy("class").agg(F.any_value("hashes").alias("hashes"))
    x, y = (exact.select(F.col("class").alias(f"class_{s}"), F.col("hashes").alias(f"hashes_{s}")) for s in "ab")
    links = (
        alike.select("class_a", "class_b").join(x, "class_a").join(y, "class_b")
        .select("class_a", "class_b", likeness("hashes_a", "hashes_b").alias("likeness"))
        .where(F.col("likeness") >= limit)
    )
    return links, docs.select("source", "key", "class").distinct()


def expanded(links: DataFrame, members: DataFrame, most: int = BUCKET_ROWS) -> DataFrame:
    """All pairs of rows (source, key_a < key_b): of two linked classes, and of one class.

    A class's rows are cut by the hash of their key into pieces of about `most`; a pair of pieces is a key of its own,
    so that a class with a third of all rows is many tasks, each with at most most x most pairs."""
    sizes = materialize(members.groupBy("class").agg(F.ceil(F.count("*") / most).cast("int").alias("pieces"), F.count("*").alias("n")), "sizes")
    a, b = (sizes.select(F.col("class").alias(f"class_{s}"), F.col("pieces").alias(f"pieces_{s}")) for s in "ab")
    own = sizes.where("n > 1").select(F.col("class").alias("class_a"), F.col("class").alias("class_b"), F.col("pieces").alias("pieces_a"), F.col("pieces").alias("pieces_b"))
    both = links.select("class_a", "class_b").join(a, "class_a").join(b, "class_b").unionByName(own)
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    both = both.withColumn("piece_a", upto("pieces_a")).withColumn("piece_b", upto("pieces_b")).where("class_a <> class_b or piece_a <= piece_b")
    both = both.select("class_a", "piece_a", "class_b", "piece_b")
    rows = members.join(sizes, "class").select("source", "key", "class", F.pmod(F.xxhash64("key"), F.col("pieces")).cast("int").alias("piece"))
    left = rows.select("source", F.col("key").alias("key_1"), F.col("class").alias("class_a"), F.col("piece").alias("piece_a"))
    right = rows.select(F.col("key").alias("key_2"), F.col("class").alias("class_b"), F.col("piece").alias("piece_b"))
    keys = ["class_a", "piece_a", "class_b", "piece_b"]
    pairs = both.join(left, ["class_a", "piece_a"]).join(both.join(right, ["class_b", "piece_b"]), keys)
    pairs = pairs.where("case when class_a = class_b and piece_a = piece_b then key_1 < key_2 else key_1 <> key_2 end")
    return pairs.select("source", F.least("key_1", "key_2").alias("key_a"), F.greatest("key_1", "key_2").alias("key_b")).distinct()


def with_links(links: DataFrame, members: DataFrame) -> DataFrame:
    """One row a record: source, key, class_id (the smallest key of its class), n_copies of its word set, and n_links,
    the number of other word sets that are near-duplicates of it."""
    ends = links.select(F.explode(F.array("class_a", "class_b")).alias("class")).groupBy("class").agg(F.count("*").alias("n_links"))
    classes = members.groupBy("class").agg(F.min("key").alias("class_id"), F.count("*").alias("n_copies"))
    return members.join(classes, "class").join(ends, "class", "left").select("source", "key", "class_id", "n_copies", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
