import datetime as dt

from memlattice.operators.references import orphan_references, orphans_by_month

T0 = dt.datetime(2025, 7, 1)


def tables(spark, refs, targets, tombs):
    return (
        spark.createDataFrame(refs, "owner_id string, ref_field string, ref_value string, seen_at timestamp, k string"),
        spark.createDataFrame(targets, "ref_field string, parent string, created_at timestamp"),
        spark.createDataFrame(tombs, "ref_field string, parent string"),
    )


def found(df):
    return sorted((r.owner_id, r.ref_field, r.ref_value, r.reason) for r in df.collect())


def test_reasons_blanks_and_case(spark):
    late = T0 + dt.timedelta(days=9)
    refs = [(f"t{i}", "m", v, T0, "clash") for i, v in enumerate([" M1 ", "m2", "m3", "gone", None, "  ", "m4", "M1"])] + [("n", "m", "m3", None, "x"), ("t1", "m", "m2", T0, "y")]
    targets = [("m", "m1", T0), ("m", " M2", late), ("m", "m2", T0), ("m", "m3", late), ("m", "m4", None), ("other", "gone", T0), ("m", None, T0), ("m", " ", T0)]
    df = orphan_references(*tables(spark, refs, targets, [("m", "GONE"), ("m", "m1")]))
    assert found(df) == [("t2", "m", "m3", "late"), ("t3", "m", "gone", "deleted")]


def test_one_hot_key_in_many_ranges_and_batches(spark):
    refs = [(f"o{i}", "m", "hot" if i % 3 else f"k{i % 50:03}", T0, "") for i in range(600)]
    targets = [("m", f"k{i:03}", T0) for i in range(0, 50, 2)]
    df = orphan_references(*tables(spark, refs, targets, []), range_rows=4, batch_rows=50)
    known = {f"k{i:03}" for i in range(0, 50, 2)}
    assert found(df) == sorted((o, f, v, "missing") for o, f, v, _, _ in refs if v not in known)
    months = {(r.ref_field, r.month, r.reason): (r.n_references, r.n_owners) for r in orphans_by_month(df).collect()}
    assert months == {("m", "2025-07", "missing"): (len(found(df)), len(found(df)))}


def test_empty_tables(spark):
    assert found(orphan_references(*tables(spark, [], [], []))) == []
    assert found(orphan_references(*tables(spark, [("a", "m", "x", T0, "")], [], []))) == [("a", "m", "x", "missing")]
