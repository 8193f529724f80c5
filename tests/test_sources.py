import pytest

from memlattice.operators import filters
from memlattice.sources import stores


def test_versions_upsert_and_migration(spark, tmp_path):
    one = stores.connect(spark, f"parquet:{tmp_path}/a?namespace=x")
    two = stores.connect(spark, f"json:{tmp_path}/b")
    rows = spark.createDataFrame([("1", "a"), ("2", "b")], "id string, v string")
    assert one.upsert("memories", rows) == 1
    assert one.upsert("memories", spark.createDataFrame([("2", "c"), ("3", None)], "id string, v string")) == 2
    assert {tuple(r) for r in one.read("memories").collect()} == {("1", "a"), ("2", "c"), ("3", None)}
    report = stores.migrate(one, two, ["memories"]).collect()
    assert [tuple(r) for r in report] == [("memories", 3, 3, 0, 0)]
    assert [tuple(r) for r in stores.migrate(one, two, ["memories"]).collect()] == [("memories", 3, 3, 0, 0)] and two.versions("memories") == [1]
    with pytest.raises(FileNotFoundError):
        two.read("edges")


def test_addresses_are_checked(spark):
    for bad in ("csv:/x", "parquet:/x?namespace=a-b"):
        with pytest.raises(ValueError):
            stores.connect(spark, bad)


def test_markdown(spark, tmp_path):
    (tmp_path / "_trash").mkdir()
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("---\ndirective: digest\ntitle: T\nsalience: 8\n---\nBody\n---\nmore")
    (tmp_path / "sub" / "b.md").write_text("---\n: [bad\n---\nText")
    (tmp_path / "sub" / "c.md").write_text("no head")
    (tmp_path / "_trash" / "d.md").write_text("---\ndirective: digest\n---\n")
    files = stores.read_markdown(spark, str(tmp_path))
    got = {r.path.rsplit("/", 1)[1]: (r.meta, r.body) for r in files.collect()}
    assert got == {"a.md": ({"directive": "digest", "title": "T", "salience": "8"}, "Body\n---\nmore"), "b.md": ({}, "Text"), "c.md": ({}, "no head")}
    assert [r.path.rsplit("/", 1)[1] for r in stores.pending_digests(files).collect()] == ["a.md"]


def test_capabilities(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("b", None), ("a", [3.0, 4.0]), (None, [])], "category string, embedding array<double>")
    assert [tuple(r) for r in stores.capabilities(df).collect()] == [(1, 2, ["a", "b"])]


CONDITIONS = [("n >= 3", [False, True, False]), ("s == 'x'", [True, False, False]), ("s != x", [False, True, True]), ("b == true", [True, False, False]), ("missing == 1", [False] * 3), ("s > a", [False] * 3), ("drop table", [False] * 3)]


@pytest.mark.parametrize("text,want", CONDITIONS, ids=[c for c, _ in CONDITIONS])
def test_conditions(spark, text, want):
    df = spark.createDataFrame([(1, 2.0, "x", True), (2, 3.0, "y", False), (3, None, None, None)], "i int, n double, s string, b boolean")
    rows = df.select("i", filters.condition(text, ["n", "s", "b"]).alias("ok")).orderBy("i").collect()
    assert [r.ok for r in rows] == want


def test_diff_counts_repeats(spark):
    a = spark.createDataFrame([("1", None), ("1", None), ("2", "x")], "id string, v string")
    b = spark.createDataFrame([("1", None), ("3", "x")], "id string, v string")
    assert tuple(filters.diff(a, b, "k").first()) == ("k", 3, 2, 2, 1)


def test_migration_guards_and_namespaces(spark, tmp_path):
    a, b = stores.connect(spark, f"parquet:{tmp_path}/a"), stores.connect(spark, f"parquet:{tmp_path}/b")
    vectors = lambda n: spark.createDataFrame([("x", [1.0] * n), ("y", None)], "id string, embedding array<float>")
    a.write("memories", vectors(3))
    report = stores.migrate(a, b, ["memories"], namespace="other").collect()
    assert [(r.n_left, r.only_left, r.only_right) for r in report] == [(2, 0, 0)] and not b.versions("memories")
    b.write("memories", vectors(4))
    with pytest.raises(ValueError, match="another length"):
        stores.migrate(a, b, ["memories"])
    b.write("memories", spark.createDataFrame([("x",)], "id string"))
    with pytest.raises(ValueError, match="other columns"):
        stores.migrate(a, b, ["memories"])
