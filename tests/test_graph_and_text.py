import uuid

import pytest
from pyspark.sql import functions as F

from notewarp.functions import scalar as S
from notewarp.functions.text import normalize_query, normalize_text, overlap_words
from notewarp.operators.graph import overview, traverse

EDGE = "source string, relation string, target string, evidence_id string, is_active boolean"
NODE = "entity_id string, canonical_name string, type_key string, status string"


def test_traversal(spark):
    edges = spark.createDataFrame(
        [("a", "r", "b", "e2", True), ("a", "r", "b", "e1", True), ("b", "r", "c", "e3", True), ("c", "r", "a", "e4", True), ("a", "self", "a", "e5", True), ("c", "q", "d", "e6", True), ("d", "q", "z", "e7", True), ("a", "r", "off", "e8", False), (None, "r", "a", "e9", True)], EDGE
    )
    nodes = spark.createDataFrame([(n, n.upper(), "t", "merged" if n == "c" else "active") for n in "abcdz"] + [("off", "OFF", "t", "active")], NODE)
    got = {(r.entity_id, r.relation_key, r.direction, r.depth, r.evidence_id) for r in traverse(edges, nodes, "a", depth=99).collect()}
    assert ("b", "r", "outgoing", 1, "e1") in got and ("a", "self", "outgoing", 1, "e5") in got and ("a", "self", "incoming", 1, "e5") in got
    assert ("d", "q", "outgoing", 2, "e6") in got and ("z", "q", "outgoing", 3, "e7") in got
    assert not any(e in ("c", "off") for e, *_ in got)
    assert traverse(edges, nodes, "a", depth=0).filter("depth > 1").count() == 0
    assert traverse(edges, nodes, "nobody").count() == 0 and traverse(edges.limit(0), nodes, "a").count() == 0
    assert len(traverse(edges, nodes, "a", limit=1).collect()) == 1


def test_large_fronts_join_by_shuffle(spark, monkeypatch):
    from notewarp.operators import graph

    edges = spark.createDataFrame([("a", "r", f"m{i}", f"e{i}", True) for i in range(20)] + [(f"m{i}", "r", "z", f"f{i}", True) for i in range(20)], EDGE)
    nodes = spark.createDataFrame([("z", "Z", "t", "active")], NODE)
    want = traverse(edges, nodes, "a").collect()
    monkeypatch.setattr(graph, "BROADCAST_PATHS", 0)
    assert traverse(edges, nodes, "a").collect() == want == [("z", "Z", "t", "r", "outgoing", 2, "f0")]


def test_overview(spark):
    nodes = spark.createDataFrame([(f"n{i}", "x", "t", "active") for i in range(5)], NODE).withColumn("updated_at", F.lit("2026-01-01").cast("timestamp"))
    edges = spark.createDataFrame([("n0", "r", "n1", "e", True), ("n0", "r", "n4", "e", True)], EDGE)
    shown, inside = overview(nodes, edges, nodes=3)
    assert {r.id for r in shown.collect()} == {"n0", "n1", "n2"} and shown.first().truncated
    assert [(r.source, r.target) for r in inside.collect()] == [("n0", "n1")]


def test_identities(spark):
    df = spark.createDataFrame([("n1", "summary", 0, "hash"), ("ü ß", "transcript", 3, "")], "n string, k string, i int, h string")
    for r in df.select("*", S.uuid5(F.col("n")).alias("u"), S.meeting_id(F.concat(F.lit(" "), F.col("n"))).alias("m"), S.evidence_id(F.col("n"), F.col("k"), F.col("i"), F.col("h")).alias("e")).collect():
        import hashlib

        assert r.u == str(uuid.uuid5(uuid.NAMESPACE_URL, r.n)) and r.m == str(uuid.uuid5(uuid.NAMESPACE_URL, S.MEETING_PREFIX + r.n))
        assert r.e == "ev_" + hashlib.sha256(f"{r.n}:{r.k}:{r.i}:{r.h}".encode()).hexdigest()[:32]


def test_text_forms(spark):
    df = spark.createDataFrame([("  Straße  ﬁne ",), (None,), ("",)], "t string")
    got = [tuple(r) for r in df.select(normalize_text("t"), normalize_query("t")).collect()]
    assert got[0] == ("strasse fine", "strasse fine") and got[1] == (None, None) and got[2] == ("", "")
    assert df.select(overlap_words(F.lit("The the an_x é99 ab"))).first()[0] == ["the", "an_x", "é99"]


def test_limits_and_labels(spark):
    assert (S.clamp(0, 1, 3), S.clamp(9, 1, 3), S.backoff_seconds(3), S.backoff_seconds(9)) == (1, 3, 8.0, 30.0)
    got = spark.range(1).select(S.label(F.lit("x" * 29)), S.label(F.lit("x" * 28)), S.is_key(F.lit("a_1")), S.is_key(F.lit("A")), S.palette_index(F.lit("abc"), 7), S.estimated_tokens(F.lit("12345"))).first()
    h = 0
    for c in "abc":
        h = (h * 31 + ord(c) + 2**31) % 2**32 - 2**31
    assert tuple(got) == ("x" * 26 + "…", "x" * 28, True, False, abs(h) % 7, 2)


@pytest.mark.parametrize("n", [0, 24])
def test_layout(spark, n):
    import math

    x, y = spark.range(1).select(*S.circle_layout(F.lit(n), F.lit(25))).first()
    r = 55 + 265 * math.sqrt((n + 1) / 25)
    assert (x, y) == pytest.approx((r * math.cos(n * 2.399963), r * math.sin(n * 2.399963)))


def simple_paths(edges, start, depth):
    """(there, relation, direction) -> (least depth, least evidence at it), by listing all simple paths."""
    steps = [(s, t, r, "outgoing", e) for s, r, t, e in edges] + [(t, s, r, "incoming", e) for s, r, t, e in edges]
    best, paths = {}, [(start,)]
    for d in range(1, depth + 1):
        longer = []
        for path in paths:
            for here, there, relation, direction, evidence in steps:
                if here == path[-1] and (d == 1 or there not in path):
                    key = (there, relation, direction)
                    best[key] = min(best.get(key, (d, evidence)), (d, evidence))
                    longer.append((*path, there))
        paths = list(dict.fromkeys(longer))
    return best


@pytest.mark.parametrize("seed", range(4))
def test_traversal_equals_listing_simple_paths(spark, seed):
    import random

    rng = random.Random(seed)
    edges = [(rng.choice("abcdefgh"), rng.choice("rs"), rng.choice("abcdefgh"), f"e{i}") for i in range(11 + 2 * seed)] + [("a", "r", "a", "loop"), ("a", "r", "b", "x"), ("b", "r", "a", "y")]
    frame = spark.createDataFrame(edges, "source string, relation string, target string, evidence_id string")
    nodes = spark.createDataFrame([(c, c, "t") for c in "abcdefgh"], "entity_id string, canonical_name string, type_key string")
    for depth in (1, 2, 3):
        got = {(r.entity_id, r.relation_key, r.direction): (r.depth, r.evidence_id) for r in traverse(frame, nodes, "a", depth=depth).collect()}
        assert got == simple_paths(edges, "a", depth)
