import random

import pytest
from tokenizers import Tokenizer

from memlattice.llm import packing as P
from memlattice.llm import skeleton as S
from memlattice.llm import tokens as T


@pytest.fixture(scope="module")
def ours():
    with open(f"{T.TOKENIZERS}/byte_bpe_50k.tiktoken", "rb") as f:
        return T.Transducer(T.read_ranks(f.read()), max_states=2000, max_words=500)


@pytest.fixture(scope="module")
def theirs():
    t = Tokenizer.from_file(f"{T.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


ODD = ["", " ", "\n\n ", "<|endoftext|>", "don't we'll I'VE", "ab" * 20_000, "a" * 5000, "Ünïcödé 日本語テスト 🧵🏽", "​﻿\x01", " 12345678901234567890", "x" * 511, "x" * 513, "\t\t\tif (a==b) {\r\n"]


def test_ids_equal_the_library(ours, theirs):
    draw = random.Random(2)
    texts = ODD + ["".join(draw.choice("abcde  theing\n\t09éя日🔁'-.") for _ in range(draw.randrange(4000))) for _ in range(60)]
    for text in texts:
        assert ours.encode(text) == theirs.encode(text, add_special_tokens=False).ids


def test_decoding_is_the_inverse_and_streams(ours):
    for text in ODD:
        assert "".join(ours.decode(ours.encode(text))) == text
    pieces = list(ours.decode(ours.encode("🧵")))
    assert pieces[0] == "" and "".join(pieces) == "🧵"
    assert "".join(ours.decode(ours.encode("🧵")[:1])) == "�"


def test_columns(spark, ours):
    df = spark.createDataFrame([(1, "a text", 5), (2, "", 6), (3, None, 7), (3, None, 7)], "doc_id bigint, text string, ids int")
    got = sorted((r.doc_id, r.ids) for r in T.encode_column(df, "doc_id", "text").collect())
    assert got == [(1, ours.encode("a text")), (2, []), (3, []), (3, [])]
    assert {(r.doc_id, r.n_tokens) for r in T.count_column(df, "doc_id", "text").collect()} == {(1, 2), (2, 0), (3, 0)}
    assert {(r.doc_id, r.text) for r in T.decode_column(T.encode_column(df, "doc_id", "text"), "doc_id").collect()} == {(1, "a text"), (2, ""), (3, "")}
    assert T.encode_column(df.limit(0), "doc_id", "text").count() == 0


LOOKS = [
    ("wide", "ＡＢＣ　１２", "ABC 12", True),
    ("composed", "café", "café", True),
    ("invisible", "in​vi­si﻿ble", "invisible", True),
    ("blank", "a b c", "a b c", True),
    ("script", "сору", "copy", True),
    ("numeral", "ⅽiⅴiⅼ Ⅻ", "civil XII", True),
    ("narrow", "ｶﾞ", "ガ", True),
    ("case", "Copy", "copy", False),
    ("accent", "cafe", "café", False),
    ("raised", "x2", "x²", False),
    ("mark", "a.", "a!", False),
    ("break", "a b", "a\nb", False),
    ("blanks", "a b", "a  b", False),
]


@pytest.mark.parametrize("name,a,b,alike", LOOKS, ids=[x[0] for x in LOOKS])
def test_skeletons(name, a, b, alike):
    assert (S.skeleton(a) == S.skeleton(b)) == alike
    assert S.skeleton(S.skeleton(a)) == S.skeleton(a)


def test_pairs_of_look_alikes(spark):
    rows = [(i, "copy text", "x") for i in range(40)] + [(90, "соpy text", "x"), (91, "copy text", "x"), (92, None, "x"), (93, "", "x"), (94, " ​", "x"), (95, "　", "x"), (96, "other", "x"), (97, "other", "x")]
    prints = S.fingerprints(spark.createDataFrame(rows, "doc_id bigint, text string, look_hash string"), "doc_id", "text")
    got = {tuple(r) for r in S.look_alike_pairs(prints).collect()}
    assert got == {(i, j) for i in range(40) for j in (90, 91)} | {(90, 91)}
    (row,) = S.look_classes(prints).collect()
    assert (row.n_texts, row.n_rows, row.first_id) == (3, 42, 0)
    assert S.look_alike_pairs(prints.limit(0)).count() == 0


def test_texts_are_paired_before_their_rows(spark):
    rows = [(i, "copy text") for i in range(200)] + [(200 + i, "соpy text") for i in range(30)] + [(300, "\uff43opy text"), (301, "other")]
    prints = S.fingerprints(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text")
    assert S.class_pairs(prints).count() == 3
    groups = [range(200), range(200, 230), [300]]
    want = sorted((i, j) for x in range(3) for y in range(x + 1, 3) for i in groups[x] for j in groups[y])
    assert sorted(tuple(r) for r in S.look_alike_pairs(prints, 3).collect()) == want


def first_fit_decreasing(sizes, room):
    bins = []
    for s in sorted(sizes, reverse=True):
        at = next((i for i, b in enumerate(bins) if b + s <= room), None)
        if at is None:
            bins.append(s)
        else:
            bins[at] += s
    return len(bins)


def test_packing(spark):
    draw = random.Random(4)
    sizes = [(i, draw.choice([None, 0, 7, 7, 7, 64, 65, 200, draw.randrange(1, 90)]), "x") for i in range(500)]
    capacities = {"small": 64, "large": 100}
    got = P.pack(spark.createDataFrame(sizes, "id bigint, size int, salt string"), capacities).collect()
    for target, room in capacities.items():
        mine = [r for r in got if r.target == target]
        whole, used = {}, {}
        for r in mine:
            whole.setdefault(r.id, []).append(r)
            if r.container is not None:
                used[r.container] = used.get(r.container, 0) + r.size
        assert {i: sum(r.size for r in v) for i, v in whole.items()} == {i: s or 0 for i, s, _ in sizes}
        assert all(len(v) == max(1, -(-sum(r.size for r in v) // room)) for v in whole.values())  # split only if too long
        assert all(sorted((r.piece, r.offset) for r in v) == [(p, p * room) for p in range(len(v))] for v in whole.values())
        assert max(used.values()) <= room and set(used) == set(range(len(used)))
        assert len(used) <= first_fit_decreasing([r.size for r in mine if r.size], room)
    assert P.pack(spark.createDataFrame([], "id bigint, size int"), capacities).count() == 0


@pytest.mark.parametrize("lengths,room", [([9, 7, 4, 2], 15), ([5, 5, 5], 4), ([8, 3], 13)])
def test_fullest_equals_brute_force(lengths, room):
    left = {n: lengths.count(n) for n in lengths}
    used = P.fullest(sorted(left, reverse=True), dict(left), room)
    sums = {0}
    for n in lengths:
        sums |= {s + n for s in sums if s + n <= room}
    assert sum(n * c for n, c in used.items()) == max(sums) and all(c <= left[n] for n, c in used.items())


def test_packing_in_shards(spark, monkeypatch):
    monkeypatch.setattr(P, "SHARD_LENGTHS", 8)
    draw = random.Random(6)
    sizes = [(i, draw.randrange(1, 60)) for i in range(400)]
    got = P.pack(spark.createDataFrame(sizes, "id bigint, size int"), {"t": 64}).collect()
    used = {}
    for r in got:
        used[r.container] = used.get(r.container, 0) + r.size
    assert sorted((r.id, r.size) for r in got) == sizes and max(used.values()) <= 64 and set(used) == set(range(len(used)))
    assert len(used) <= first_fit_decreasing([s for _, s in sizes], 64)


def test_members_of_looks(spark):
    rows = [(i, "copy text") for i in range(40)] + [(90, "соpy text"), (91, "ꓚopy text"), (92, None), (93, "other")]
    prints = S.fingerprints(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text")
    got = {r.id: (r.class_id, r.text_id, r.n_texts, r.n_rows) for r in S.look_members(prints).collect()}
    assert got == {i: (0, 0, 2, 41) for i in range(40)} | {90: (0, 90, 2, 41)}


def test_packing_sends_no_table_that_grows(spark):
    draw = random.Random(5)
    sizes = [(i, 7 if i % 2 else draw.randrange(1, 200)) for i in range(6000)]
    packed = P.pack(spark.createDataFrame(sizes, "id bigint, size int"), {"t": 64})
    got = packed.collect()
    held, containers = dict.fromkeys(range(6000), 0), {}
    for r in got:
        held[r.id] += r.size
        containers[r.container] = containers.get(r.container, 0) + r.size
    assert held == dict(sizes) and max(containers.values()) <= 64
    plan = packed._jdf.queryExecution().executedPlan().toString()  # the one that ran
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
