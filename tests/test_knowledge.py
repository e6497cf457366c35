import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from notewarp.operators import ontology as O
from notewarp.operators.context import evidence_context, ontology_context
from notewarp.operators.extraction import contract_errors, extract, parse, within_budget
from notewarp.operators.ordered import numbered_runs
from notewarp.operators.resolve import resolve
from notewarp.streaming import queue as Q

CAND = "candidate_no long, type_key string, name string, note_id string, scope_note_id string, identifiers array<struct<field_key:string,value:string>>"


def sources(spark, rows):
    return {r.candidate_no: (r.entity_id, r.match_source) for r in resolve(spark.createDataFrame(rows, CAND)).collect()}


def test_resolution_order(spark):
    e = [("email", "Alex@Example.com ")]
    got = sources(
        spark,
        [
            (1, "person", "Alex Choi", "n1", None, e),
            (2, "person", "Alex", "n1", None, [("email", "alex@example.com")]),
            (3, "person", "Alex", "n2", None, []),
            (4, "meeting", "Weekly sync", "not_1", None, []),
            (5, "meeting", "Weekly sync", "not_2", None, None),
            (6, "decision", "Launch", "n1", "n1", []),
            (7, "decision", "launch ", "n1", "n1", []),
            (8, "decision", "Launch", "n2", "n2", []),
            (9, "company", "Alex", None, None, [("email", " ")]),
        ],
    )
    assert got[1][1] == "created" and got[2] == (got[1][0], "exact_identifier") and got[3] == (got[1][0], "exact_alias")
    assert got[4][0] != got[5][0]
    assert got[6][0] == got[7][0] != got[8][0] and got[7][1] == "exact_name"
    assert got[9][0] != got[1][0]


def test_conflicting_identifiers(spark):
    got = sources(spark, [(1, "person", "A", None, None, [("email", "a@x")]), (2, "person", "B", None, None, [("email", "b@x")]), (3, "person", "C", None, None, [("email", "a@x"), ("email", "b@x")])])
    assert got[3] == (None, "conflict") and got[1][0] != got[2][0]


def test_copies_and_empty(spark):
    got = sources(spark, [(i, "person", "Same Name", None, None, []) for i in range(30)] + [(None, "person", "x", None, None, []), (99, None, "x", None, None, [])])
    assert len({e for e, _ in got.values()}) == 1 and [s for _, s in got.values()].count("created") == 1 and len(got) == 30
    assert sources(spark, []) == {}


def test_ontology_evolution(spark):
    seed = O.seed(spark)
    proposed = {
        "entity_types": spark.createDataFrame([("company", "Company", "c", "global"), ("person", "Human", "new words", "note"), ("subject", "Subject", "s", "note")], "type_key string, display_name string, description string, identity_scope string"),
        "field_definitions": spark.createDataFrame([("company", "site", "Site", "", "url", True), ("person", "email", "Mail", "", "string", False)], "type_key string, field_key string, display_name string, description string, data_type string, is_identifier boolean"),
        "relation_types": spark.createDataFrame([("attended", "was at", "", "company", "company", False)], "relation_key string, display_name string, description string, source_type_key string, target_type_key string, is_directed boolean"),
    }
    two = O.evolve(seed, proposed, 2)
    person = two["entity_types"].filter("type_key = 'person'").first()
    assert (person.display_name, person.identity_scope, person.created_revision, person.updated_revision, person.is_seed) == ("Human", "global", 1, 2, True)
    assert two["field_definitions"].filter("field_key = 'email'").first().is_identifier is True
    assert two["relation_types"].first().source_type_key == "person" and two["relation_types"].first().display_name == "was at"
    more = {
        "entity_types": spark.createDataFrame([("organization", "Org", "o", "global")], proposed["entity_types"].schema),
        "field_definitions": spark.createDataFrame([("organization", "vat", "VAT", "", "string", True)], proposed["field_definitions"].schema),
        "relation_types": spark.createDataFrame([("works_at", "w", "", "person", "organization", True)], proposed["relation_types"].schema),
    }
    three = O.evolve(two, more, 3)
    assert [(r.alias_key, r.canonical_type_key) for r in three["entity_type_aliases"].collect()] == [("organization", "company")]
    assert three["field_definitions"].filter("field_key = 'vat'").first().type_key == "company"
    assert three["relation_types"].filter("relation_key = 'works_at'").first().target_type_key == "company"
    assert three["entity_types"].filter("type_key = 'organization'").count() == 0


def test_evidence_context_budget(spark):
    ev = spark.createDataFrame(
        [("ev_s", "n", "summary", 0, "Zenning launch", True), ("ev_w", "n", "transcript", 0, "Weather discussion is unrelated", True), ("ev_z", "n", "transcript", 1, "Zenning customer", True), ("ev_off", "n", "transcript", 2, "Zenning Zenning", False), ("ev_o", "other", "transcript", 0, "alone", True)],
        "evidence_id string, note_id string, unit_kind string, unit_index long, content string, is_active boolean",
    )
    notes = spark.createDataFrame([("n", "Zenning"), ("other", None)], "note_id string, title string")
    got = [(r.evidence_id, r.content) for r in evidence_context(ev, notes, budget=30).filter("note_id = 'n'").orderBy("place").collect()]
    assert got == [("ev_s", "Zenning launch"), ("ev_z", "Zenning customer")]
    got = [r.content for r in evidence_context(ev, notes, budget=20).filter("note_id = 'n'").orderBy("place").collect()]
    assert got == ["Zenning launch", "Zennin"]


def test_ontology_context(spark):
    types = spark.createDataFrame([(k, k, "", "global", 1, 1, s) for k, s in (("meeting", True), ("person", True), ("company", False), ("decision", False), ("project", False))], O.TYPES)
    fields = spark.createDataFrame([], O.FIELDS)
    relations = spark.createDataFrame([("a", "", "", "person", "company", True, 1), ("b", "", "", "person", "project", True, 1)], O.RELATIONS)
    shown, ends = ontology_context(types, fields, relations, "Zenning company strategy", rows=3)
    assert {r.type_key for r in shown.collect()} == {"meeting", "person", "company"} and [r.relation_key for r in ends.collect()] == ["a"]


def test_extraction_contract(spark):
    def doc(**change):
        d = {"ontology": {"entity_types": [], "relation_types": []}, "entities": [{"local_id": "a", "type_key": "person", "name": "A", "identifiers": [], "evidence_ids": ["e"], "properties": []}], "relations": []}
        d.update(change)
        return json.dumps(d)

    rel = {"source_local_id": "a", "relation_key": "r", "target_local_id": "nobody", "evidence_ids": ["e"], "confidence": 0.5}
    rows = [("ok", doc()), ("end", doc(relations=[rel])), ("sure", doc(relations=[{**rel, "target_local_id": "a", "confidence": 2.0}])), ("keys", doc(more=1)), ("bad", "{"), ("twice", doc(entities=[json.loads(doc())["entities"][0]] * 2))]
    errors = {r.note_id: r.error for r in contract_errors(parse(spark.createDataFrame(rows, "note_id string, response string"))).collect()}
    assert errors == {"end": "unknown_endpoint", "sure": "confidence", "keys": "unknown_keys", "bad": "malformed", "twice": "repeated_local_id"}


def test_extractor_errors_stay_with_their_note(spark):
    prompts = spark.createDataFrame([("a", "t", "[]", "{}"), ("b", "boom", "[]", "{}"), ("c", "x" * 400, "[]", "{}")], "note_id string, title string, evidence_json string, ontology_json string")

    def model(title, evidence, ontology):
        if title == "boom":
            raise ValueError("no")
        return "{}"

    assert within_budget(prompts, tokens=50).count() == 2
    got = {r.note_id: (r.response, r.error) for r in extract(prompts, model).collect()}
    assert got["a"] == ("{}", None) and got["b"] == (None, "ValueError: no")


def test_queue_life(spark):
    t = lambda m: dt.datetime(2026, 7, 15, 9, m)
    feed = spark.createDataFrame([("n1", t(1)), ("n2", t(2)), ("n1", t(1)), (None, t(9))], "id string, updated_at timestamp")
    q = Q.discover(spark.createDataFrame([], Q.QUEUE), feed, now="2026-07-15 10:00:00")
    assert {r.state: r.n for r in Q.counts(q).collect()} == {"pending": 2, "processing": 0, "complete": 0, "failed": 0}
    q, taken = Q.claim(q, limit=1, now="2026-07-15 10:01:00")
    assert [(r.note_id, r.attempts) for r in taken.collect()] == [("n1", 1)]
    failed = spark.createDataFrame([("n1", "boom"), ("n2", "not processing")], "note_id string, error string")
    assert [r.note_id for r in Q.not_processing(q, failed).collect()] == ["n2"]
    q = Q.finish(q, failed, now="2026-07-15 10:02:00")
    assert {r.note_id: (r.state, r.last_error) for r in q.collect()} == {"n1": ("failed", "boom"), "n2": ("pending", None)}
    q, _ = Q.claim(q, now="2026-07-15 10:03:00")
    assert {r.note_id: (r.state, r.attempts) for r in q.collect()} == {"n1": ("processing", 2), "n2": ("processing", 1)}
    q = Q.finish(Q.claim(Q.recover(q), now="2026-07-15 10:04:00")[0], spark.createDataFrame([("n1", None), ("n2", None)], "note_id string, error string"))
    assert {r.note_id: (r.state, r.attempts) for r in q.collect()} == {"n1": ("complete", 3), "n2": ("complete", 2)}
    assert Q.claimable(q).count() == 0
    same = Q.discover(q, feed)
    assert {r.state for r in same.collect()} == {"complete"}
    later = Q.discover(q, feed.withColumn("updated_at", F.expr("updated_at + interval 1 hour")))
    assert {(r.state, r.attempts) for r in later.collect()} == {("pending", 0)}
    again = Q.reprocess(q, spark.createDataFrame([("n2",), ("unknown",)], "note_id string"))
    assert {r.note_id: (r.state, r.force_reprocess) for r in again.collect()} == {"n1": ("complete", False), "n2": ("pending", True)}
    spent = q.withColumn("state", F.lit("failed")).withColumn("attempts", F.lit(2))
    assert Q.claimable(spent, max_attempts=2).count() == 0


def test_mark_moves_only_forward_and_on_success(spark):
    from notewarp.streaming.discovery import SYNC_STATE

    t = dt.datetime(2026, 7, 15)
    feed = spark.createDataFrame([("n", t)], "id string, updated_at timestamp")
    state = Q.advance(spark.createDataFrame([], SYNC_STATE), "s", feed, now="2026-07-16 00:00:00")
    assert state.first().watermark == t and Q.after_mark(feed, state, "s").count() == 0 and Q.after_mark(feed, state, "x").count() == 1
    late = feed.withColumn("updated_at", F.expr("updated_at - interval 1 day"))
    assert Q.advance(state, "s", late).first().watermark == t
    broken = Q.advance(state, "s", feed.withColumn("updated_at", F.expr("updated_at + interval 1 day")), error="HTTP 503").first()
    assert (broken.watermark, broken.last_error) == (t, "HTTP 503")
    assert Q.advance(state, "s", feed.limit(0)).first().watermark == t


@pytest.mark.parametrize("step", [1, 7, 1000])
def test_runs_do_not_depend_on_buckets(spark, step):
    values = "aabbbaaccccabcaa"
    rows = [("k", i // step, i, v) for i, v in enumerate(values)] + [("other", 0, 0, "a")]
    got = {r.i: r.run for r in numbered_runs(spark.createDataFrame(rows, "k string, b long, i long, v string"), "k", "b", ["i"], "v").filter("k = 'k'").collect()}
    want, n = {}, 0
    for i, v in enumerate(values):
        n += i == 0 or values[i - 1] != v
        want[i] = n
    assert got == want


def test_resolution_against_the_store(spark):
    known = {
        "entities": spark.createDataFrame(
            [("E1", "person", "Alex Choi", "active", None), ("E2", "person", "Sam Lee", "active", None), ("E3", "person", "Sam Lee", "active", None), ("E4", "person", "Old Name", "merged", None), ("D1", "decision", "Launch", "active", "n1")],
            "entity_id string, type_key string, canonical_name string, status string, scope_note_id string",
        ),
        "entity_aliases": spark.createDataFrame([("E1", "A. Choi"), ("E2", "Sammy"), ("E3", "Sammy")], "entity_id string, alias string"),
        "entity_identifiers": spark.createDataFrame([("E1", "email", "alex@x"), ("E2", "email", "sam@x"), ("E4", "email", "old@x")], "entity_id string, field_key string, normalized_value string"),
    }
    rows = [
        (1, "person", "Somebody", "n", None, [("email", "ALEX@x ")]),
        (2, "person", "alex  choi", "n", None, []),
        (3, "person", "A. Choi", "n", None, [("email", "new@x")]),
        (4, "person", "Other", "n", None, [("email", "new@x")]),
        (5, "person", "Sam Lee", "n", None, []),
        (6, "person", "sammy", "n", None, None),
        (7, "person", "Old Name", "n", None, [("email", "old@x")]),
        (8, "person", "X", "n", None, [("email", "alex@x"), ("email", "sam@x")]),
        (9, "decision", "Launch", "n1", "n1", []),
        (10, "decision", "Launch", "n2", "n2", []),
        (11, "person", "Somebody", "n", None, []),
    ]
    got = {r.candidate_no: (r.entity_id, r.match_source) for r in resolve(spark.createDataFrame(rows, CAND), known).collect()}
    assert got[1] == ("E1", "exact_identifier") and got[2] == ("E1", "exact_name") and got[3] == ("E1", "exact_alias") and got[4] == ("E1", "exact_identifier")
    assert got[5][1] == got[6][1] == got[7][1] == "created" and len({got[i][0] for i in (5, 6, 7)}) == 3 and got[7][0] != "E4"
    assert got[8] == (None, "conflict") and got[9] == ("D1", "exact_name") and got[10][1] == "created"
    assert got[11] == ("E1", "exact_alias")  # the name the first candidate brought


def test_a_shared_key_is_no_ones_task(spark):
    """One mailbox on a third of all candidates: they are one entity, and no step groups them."""
    rows = [(i, "person", f"P{i}", None, None, [("email", "info@x")] if i % 3 == 0 else [("email", f"{i}@x")]) for i in range(1, 600)]
    result = resolve(spark.createDataFrame(rows, CAND))
    got = {r.candidate_no: r.entity_id for r in result.collect()}
    assert len({got[i] for i in range(3, 600, 3)}) == 1 and len(set(got.values())) == 401
    assert "FlatMapGroups" not in result._jdf.queryExecution().toString()


def test_scopes_are_checked(spark):
    from notewarp.operators.resolve import scope_errors

    types = spark.createDataFrame([("person", "global"), ("decision", "note")], "type_key string, identity_scope string")
    c = spark.createDataFrame([(1, "person", None), (2, "person", "n"), (3, "decision", " "), (4, "decision", None), (5, "x", None)], "candidate_no long, type_key string, scope_note_id string")
    assert {r.candidate_no: r.error for r in scope_errors(c, types).collect()} == {2: "scope not allowed", 4: "scope missing", 5: "unknown type"}


def test_only_what_is_being_processed_can_end(spark):
    queue = spark.createDataFrame([("a", "processing"), ("b", "pending"), ("c", "processing")], "note_id string, state string").selectExpr("*", "timestamp '2026-01-01' as remote_updated_at", "1 as attempts", "cast(null as string) as last_error", "false as force_reprocess", "timestamp '2026-01-01' as queued_at", "timestamp '2026-01-01' as updated_at")
    outcome = lambda *rows: spark.createDataFrame(list(rows), "note_id string, error string")
    done = {r.note_id: (r.state, r.last_error) for r in Q.settle(queue, outcome(("a", None), ("c", "bad"))).collect()}
    assert done == {"a": ("complete", None), "b": ("pending", None), "c": ("failed", "bad")}
    for wrong in ("b", "nobody"):
        with pytest.raises(ValueError, match=wrong):
            Q.settle(queue, outcome(("a", None), (wrong, None)))
    state = spark.createDataFrame([], "source_key string, watermark timestamp, last_started_at timestamp, last_completed_at timestamp, last_error string")
    begun = Q.begin(state, "notes", now="2026-02-01 00:00:00").first()
    assert begun.source_key == "notes" and begun.last_started_at == dt.datetime(2026, 2, 1) and begun.watermark is None
    # what was never materialised is not skipped
    claimed = spark.createDataFrame([("a", False), ("b", False), ("c", True)], "note_id string, force_reprocess boolean")
    notes = spark.createDataFrame([("a", None, None), ("b", "h", "h"), ("c", "h", "h")], "note_id string, content_hash string, processed_hash string")
    assert [r.note_id for r in Q.skippable(claimed, notes).collect()] == ["b"]
