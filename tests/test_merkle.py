import datetime as dt

import pytest

from notewarp.operators.due_notes import due_notes
from notewarp.operators.merkle import MerkleStore, depth_for
from notewarp.operators.snapshot import Snapshot, discover_steps

REC = "key string, digest string"


def keys(df):
    return sorted((r.key, r.change) for r in df.collect())


def test_store_processes_only_changes_and_survives_failures(spark, tmp_path):
    store = MerkleStore(spark, f"file://{tmp_path}/state")
    one = spark.createDataFrame([(f"k{i}", "1") for i in range(200)] + [(None, "x"), ("k5", "1")], REC)
    seen = []
    store.run(one, lambda p: seen.append(keys(p)) or p)
    assert len(seen[-1]) == 200 and {c for _, c in seen[-1]} == {"added"}
    two = spark.createDataFrame([(f"k{i}", "2" if i in (7, 150) else "1") for i in range(1, 200)] + [("new", None)], REC)

    def dies(pending):
        seen.append(keys(pending))
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        store.run(two, dies)
    assert store.version() == 1
    expected = [("k0", "removed"), ("k150", "changed"), ("k7", "changed"), ("new", "added")]
    assert seen[-1] == expected
    store.run(two, lambda p: seen.append(keys(p)) or p)
    assert seen[-1] == expected and store.version() == 2 and keys(store.output()) == expected
    store.run(two, lambda p: seen.append(keys(p)) or p)
    assert seen[-1] == [] and store.saved().count() == 200
    with pytest.raises(RuntimeError):
        store.publish(two, two, expected=1)


def test_only_differing_leaves_are_read_and_written(spark, tmp_path):
    store = MerkleStore(spark, f"file://{tmp_path}/state")
    rows = spark.range(40_000).selectExpr("cast(id as string) as key", "'1' as digest")
    store.run(rows, lambda p: p.limit(0))
    before = set(store.saved().inputFiles())
    changed = rows.selectExpr("key", "if(key in ('17', '39999'), '2', '1') as digest")
    c = store.compare(changed)
    assert c.depth == depth_for(40_000) == 3 and c.n_leaves == 2 and len(c.folders) <= 2
    read = store.saved(c.folders)
    assert set(read.inputFiles()) < before and len(read.inputFiles()) <= 2
    assert read.join(c.leaves, "leaf", "left_semi").count() < 100
    assert keys(store.pending(c)) == [("17", "changed"), ("39999", "changed")]
    store.publish(c, store.pending(c))
    kept = before & set(store.saved().inputFiles())
    assert len(kept) >= len(before) - 2 and store.saved().count() == 40_000
    # far more records: the tree gets another depth, and the next comparison still sees the changes only
    more = spark.range(300_000).selectExpr("cast(id as string) as key", "'1' as digest")
    store.run(more, lambda p: p.limit(0))
    assert store.compare(more).depth == 4 and store.pending(more).isEmpty()
    assert keys(store.pending(more.filter("key <> '5'"))) == [("5", "removed")]
    assert store.pending(more.limit(0)).count() == 300_000


def test_a_losing_writer_changes_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/state"
    a, b = MerkleStore(spark, path), MerkleStore(spark, path)
    one, two = spark.createDataFrame([("k", "a")], REC), spark.createDataFrame([("k", "b")], REC)
    stale = b.compare(two)
    a.run(one, lambda p: p)
    with pytest.raises(RuntimeError):
        b.publish(stale, b.pending(stale))
    assert [r.digest for r in a.output().collect()] == ["a"] and a.version() == 1 and [r.digest for r in a.saved().collect()] == ["a"]
    # the same for tables
    left, right = Snapshot(spark, f"{path}/t"), Snapshot(spark, f"{path}/t")
    base = left.manifest()["version"]
    left.commit({"x": one})
    with pytest.raises(RuntimeError):
        right.commit({"x": two}, expected=base)
    right._manifests.read = lambda: {}
    with pytest.raises(RuntimeError):
        right.commit({"x": two})
    assert [r.digest for r in left.table("x").collect()] == ["a"]


def test_schema_steps_are_found_in_order():
    assert discover_steps({"002_b": 2, "001_a": 1}) == [1, 2]
    for bad in ({"1_a": 1}, {"001_a": 1, "003_b": 1}, {"001_a": 1, "001_b": 1}):
        with pytest.raises(ValueError):
            discover_steps(bad)


def test_due_notes(spark):
    t = lambda m: dt.datetime(2026, 1, 1, 0, m)
    feed = [("new", t(1)), ("done", t(1)), ("done", t(1)), ("later", t(2)), ("later", t(1)), ("spent", t(3)), ("forced", t(1)), ("other", t(5)), (None, t(1)), ("null", None)]
    q = [
        (1, "done", t(1), "complete", 1, False),
        (2, "later", t(1), "complete", 1, False),
        (3, "spent", t(3), "failed", 5, False),
        (4, "forced", t(1), "complete", 1, False),
        (5, "forced", t(1), "pending", 0, True),
        (6, "other", t(4), "failed", 9, None),
        (7, "unfed", t(4), "pending", 0, True),
        (8, None, t(4), None, None, None),
    ]
    f = spark.createDataFrame(feed, "id string, updated_at timestamp").selectExpr("*", "'x' as state", "1 as attempts")
    queue = spark.createDataFrame(q, "queue_seq long, note_id string, remote_updated_at timestamp, state string, attempts int, force_reprocess boolean")
    assert {r.note_id for r in due_notes(f, queue).collect()} == {"new", "later", "forced", "other"}
    assert due_notes(f.limit(0), queue).count() == 0
    assert due_notes(f, queue.limit(0)).count() == 6
