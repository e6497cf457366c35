import pytest
from pyspark.sql import functions as F

from notewarp.operators.merge import flag_where, hide_missing, insert_or_ignore, last_by, upsert, with_defaults
from notewarp.operators.snapshot import Snapshot


def rows(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


def test_upsert_keeps_refreshes_and_adds(spark):
    old = spark.createDataFrame([("a", 1, "x", False), ("b", 2, "y", True), (None, 9, "n", True)], "k string, v int, kept string, is_active boolean")
    new = spark.createDataFrame([("a", 5, "z", 1), ("a", 7, "w", 2), ("c", 3, None, 1)], "k string, v int, kept string, seq int")
    out = upsert(old, new, ["k"], keep=["kept"], order=["seq"], set_on_update={"is_active": F.lit(True)})
    assert rows(out.select("k", "v", "kept", "is_active")) == sorted([("a", 7, "x", True), ("b", 2, "y", True), ("c", 3, None, None), (None, 9, "n", True)], key=repr)
    assert rows(upsert(old, new.limit(0), ["k"]).select("k", "v")) == rows(old.select("k", "v"))
    assert upsert(old.limit(0), new, ["k"]).count() == 2


def test_insert_or_ignore_first_writer_wins(spark):
    old = spark.createDataFrame([("a", 1)], "k string, v int")
    new = spark.createDataFrame([("a", 2), ("b", 4), ("b", 3)], "k string, v int")
    assert rows(insert_or_ignore(old, new, ["k"], order=["v"])) == [("a", 1), ("b", 3)]


def test_flags_and_hiding(spark):
    facts = spark.createDataFrame([(1, "e1", True), (2, "e2", True), (3, None, True)], "id int, ev string, is_active boolean")
    hit = spark.createDataFrame([("e1",), ("e1",), (None,)], "ev string")
    assert rows(flag_where(facts, hit, "ev", "is_active", F.lit(False)).select("id", "is_active")) == [(1, False), (2, True), (3, True)]
    notes = spark.createDataFrame([("a", "active"), ("b", "active"), ("c", "hidden")], "note_id string, visibility string")
    assert rows(hide_missing(notes, notes.filter("note_id = 'a'"))) == [("a", "active"), ("b", "hidden"), ("c", "hidden")]


def test_last_by_and_defaults(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2)], "k string, v int")
    assert rows(last_by(df, ["k"])) == [("a", 2)]
    assert with_defaults(df, {"n": F.lit(0), "v": F.lit(5)}).columns == ["k", "v", "n"]


def test_snapshot_is_atomic_and_migrates(spark, tmp_path):
    store = Snapshot(spark, f"file://{tmp_path}/s")
    a = spark.createDataFrame([(1,)], "x int")
    assert store.commit({"a": a, "b": a}) == 1
    bad = a.select(F.raise_error(F.lit("no")).alias("x"))
    with pytest.raises(Exception):
        store.commit({"a": a.union(a), "b": bad})
    assert store.manifest()["version"] == 1 and store.table("a").count() == 1
    store.commit({"a": a.union(a)})
    assert (store.table("a").count(), store.table("b").count()) == (2, 1)
    assert store.migrate([lambda t: {}, lambda t: {"a": with_defaults(t["a"], {"y": F.lit(0)})}]) == 2
    assert store.migrate([lambda t: {}, lambda t: {}]) == 2
    assert store.table("a").columns == ["x", "y"]
