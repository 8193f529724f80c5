import random
import re
from itertools import combinations

import numpy as np

from memlattice.llm import near_duplicates as N

KIND = "source string, key string, text string, sketch string"


def pairs_by_force(rows, limit=0.7, least=8):
    sets = {(s, k, frozenset(re.findall(r"[^\W_]+", (t or "").lower()))) for s, k, t, _ in rows}
    out = set()
    for a, b in combinations(sorted(sets, key=lambda x: x[:2]), 2):
        if a[0] == b[0] and a[1] != b[1] and min(len(a[2]), len(b[2])) >= least and len(a[2] & b[2]) >= limit * len(a[2] | b[2]):
            out.add((a[0], *sorted((a[1], b[1]))))
    return out


def found(spark, rows):
    df = spark.createDataFrame(rows, KIND).repartition(3)
    links, members = N.near_duplicates(df)
    return {(r.source, r.key_a, r.key_b) for r in N.expanded(links, members).collect()}, links, members


def corpus(seed, n=60):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["the", "of", "a"]
    rows = []
    for i in range(n):
        base = draw.sample(vocabulary, draw.randrange(10, 60))
        for j in range(draw.randrange(1, 4)):
            text = list(base)
            for _ in range(draw.choice([0, 1, 1, 6])):
                text[draw.randrange(len(text))] = draw.choice(vocabulary)
            draw.shuffle(text)
            rows.append((draw.choice("ab") if j == 0 else rows[-1][0], f"k{i}-{j}", " ".join(text).title() + "!", "clash"))
    return rows


def far_from_the_limit(rows):
    """Without pairs that are too near the limit for a method with a small miss rate."""
    near = pairs_by_force(rows, 0.66) - pairs_by_force(rows, 0.74)
    drop = {k for _, a, b in near for k in (a, b)}
    return [r for r in rows if r[1] not in drop]


def test_equals_brute_force(spark):
    rows = far_from_the_limit(corpus(5))
    got, _, _ = found(spark, rows)
    assert got == pairs_by_force(rows) and len(got) > 20


def test_copies_nulls_short_texts_and_repeats(spark):
    text = "one two three four five six seven eight nine"
    rows = [("a", f"c{i}", text if i % 2 else text.upper() + " ...", "") for i in range(8)]
    rows += [("a", "n", None, ""), ("a", "e", "", ""), ("a", "s", "too short", ""), ("b", "c0", text, ""), rows[0]]
    got, links, members = found(spark, rows)
    assert got == {("a", f"c{i}", f"c{j}") for i in range(8) for j in range(i + 1, 8)}
    one = {(r.source, r.key): (r.class_id, r.n_copies, r.n_links) for r in N.with_links(links, members).collect()}
    assert one[("a", "c3")] == ("c0", 8, 0) and one[("b", "c0")] == ("c0", 1, 0)


def test_empty_table_and_very_long_text(spark):
    assert found(spark, [])[0] == set()
    long = " ".join(f"x{i}" for i in range(30_000))
    assert found(spark, [("a", "1", long, ""), ("a", "2", long + " more", "")])[0] == {("a", "1", "2")}


def test_sketch_estimates_likeness():
    draw = np.random.default_rng(1)
    a = draw.integers(1, 2**63, 200, dtype=np.uint64)
    b = np.concatenate([a[:180], draw.integers(1, 2**63, 20, dtype=np.uint64)])
    s = N.samples(np.concatenate([np.sort(a), np.sort(b)]), np.array([0, 200]), 308)
    x, y = N.odd_sketch(s, 512)
    differ = int(np.unpackbits(x ^ y).sum())
    assert abs(1 + 512 / (4 * 308) * np.log(1 - 2 * differ / 512) - 180 / 220) < 0.12


def test_large_buckets_are_compared_in_parts(spark):
    rows = [(1, c, 30) for c in range(30)] + [(2, c, 2) for c in (3, 99)]
    keyed = spark.createDataFrame(rows, "bucket bigint, class bigint, n bigint")
    got = sorted(tuple(r) for r in N.bucket_pairs(keyed, most=7).collect())
    assert got == sorted([*combinations(range(30), 2), (3, 99)])


def test_a_copy_with_a_null_key_takes_no_links_away(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [("a", None, text, ""), ("a", "k1", text, ""), ("a", "k2", text + " eleven", "")]
    links, members = N.near_duplicates(spark.createDataFrame(rows, KIND).coalesce(1))
    assert {tuple(r) for r in N.expanded(links, members).collect()} == {("a", "k1", "k2")}


def test_rows_of_hot_classes_are_paired_in_pieces(spark):
    members = spark.createDataFrame([("a", f"x{i:02}", 1) for i in range(25)] + [("a", f"y{i}", 2) for i in range(7)] + [("a", "z", 3)], "source string, key string, class bigint")
    links = spark.createDataFrame([(1, 2, 0.8)], "class_a bigint, class_b bigint, likeness double")
    keys = {r.key: r["class"] for r in members.collect()}
    want = {("a", *p) for p in combinations(sorted(keys), 2) if {keys[p[0]], keys[p[1]]} <= {1, 2}}
    for most in (3, 1000):
        rows = [tuple(r) for r in N.expanded(links, members, most).collect()]
        assert set(rows) == want and len(rows) == len(want)


def test_a_third_of_all_records_in_one_class_and_one_bucket(spark):
    rows = far_from_the_limit(corpus(7, 30))
    text = "one two three four five six seven eight nine ten"
    rows += [("a", f"hot{i}", text if i % 2 else text + " !", "") for i in range(len(rows) // 2 + 2)] + [("a", "near", text + " eleven", "")]
    got, _, members = found(spark, rows)
    assert got == pairs_by_force(rows)
    assert members.groupBy("class").count().agg({"count": "max"}).first()[0] * 3 >= len(rows)
