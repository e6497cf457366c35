import datetime as dt
import json

import pytest

from tests.paged_service import note, service

from notewarp.plans.engine import Engine
from notewarp.sources import paged
from notewarp.streaming.discovery import feed_stream, run as run_stream
from notewarp.operators.snapshot import Snapshot

DETAIL = (
    "id string, detail_no long, title string, owner struct<name:string,email:string>, created_at timestamp, updated_at timestamp, web_url string, "
    "calendar_event struct<calendar_event_id:string,scheduled_start_time:timestamp,scheduled_end_time:timestamp>, folder_membership array<struct<id:string>>, summary_text string"
)
T = dt.datetime(2026, 7, 15, 9)


def test_engine_end_to_end(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/kg")
    engine.init()
    engine.init()
    feed = spark.createDataFrame([("not_1", "Quarterly budget", T), ("not_2", None, T), ("not_3", "Lost", T)], "id string, title string, updated_at timestamp")
    assert engine.sync(feed) == {"discovered": 3, "enqueued": 3, "hidden": 0}
    assert engine.sync(feed)["discovered"] == 0
    details = spark.createDataFrame([("not_1", 1, "Quarterly budget", ("O", "o@x"), T, T, "u", None, [], "Alex approved the budget."), ("not_2", 2, None, (None, "p@x"), T, T, "u", None, [], "bad one")], DETAIL)

    def model(title, evidence, ontology):
        if title == "Untitled meeting":
            raise RuntimeError("refused")
        ev = [e["evidence_id"] for e in json.loads(evidence)]
        return json.dumps(
            {
                "ontology": {"entity_types": [{"key": "person", "display_name": "Person", "description": "A person", "identity_scope": "global", "fields": [{"key": "role", "display_name": "Role", "description": "", "data_type": "string", "is_identifier": False}]}], "relation_types": []},
                "entities": [
                    {"local_id": "p", "type_key": "person", "name": "Alex Choi", "identifiers": [{"field_key": "email", "value": "alex@x"}], "evidence_ids": ev, "properties": [{"field_key": "role", "value": "Approver", "evidence_ids": ev, "confidence": 0.9}]},
                    {"local_id": "m", "type_key": "meeting", "name": title, "identifiers": [], "evidence_ids": ev, "properties": []},
                ],
                "relations": [{"source_local_id": "p", "relation_key": "attended", "target_local_id": "m", "evidence_ids": ev, "confidence": 1.0}],
            }
        )

    assert engine.process(details, model, max_attempts=2) == {"completed": 1, "skipped": 0, "failed": 2}
    assert {r.note_id: r.attempts for r in engine.table("queue").collect()} == {"not_1": 1, "not_2": 2, "not_3": 2}
    assert engine.table("extraction_runs").select("note_id", "state", "prompt_version", "input_tokens").collect() == [("not_1", "complete", "v1", 0)]
    assert engine.table("ontology_revisions").count() == 2 and engine.table("entity_identifiers").filter("normalized_value = 'alex@x'").count() == 1
    assert engine.table("evidence").filter("note_id = 'not_2'").count() == 1  # evidence survives a failed extraction
    status = engine.status()
    assert (status["complete"], status["failed"], status["watermark"]) == (1, 2, T)
    found = engine.search("alex").collect()
    assert {r.kind for r in found} == {"entity", "note", "evidence"}
    person = next(r.object_id for r in found if r.kind == "entity")
    walk = engine.traverse(person, depth=99).collect()
    assert [(r.relation_key, r.direction, r.depth) for r in walk] == [("attended", "outgoing", 1)]
    detail = engine.entity(person).first()
    assert [(r.relation, r.other_name) for r in engine.panel(person).collect()] == [("attended", "Quarterly budget")]
    assert engine.record(person).first().status == "active" and [(i.field_key, i.raw_value) for i in detail.identifiers] == [("email", "alex@x")]
    assert detail.aliases == ["Alex Choi"] and detail.properties[0].citation.note_title == "Quarterly budget"
    assert engine.evidence(detail.properties[0].citation.evidence_id).count() == 1
    n_edges = engine.table("edges").count()
    engine.reprocess(["not_1"])
    engine.process(details, model, max_attempts=1)
    assert engine.table("edges").count() == n_edges and engine.table("edges").filter("is_active").count() == n_edges
    with pytest.raises(KeyError):
        engine.reprocess(["nobody"])
    assert engine.sync(feed.filter("id <> 'not_1'"), reconcile=True)["hidden"] == 1
    assert not [r for r in engine.search("alex").collect() if r.kind != "entity"]
    engine.sync(feed, error="HTTP 503")
    assert engine.status()["last_error"] == "HTTP 503"


def test_stream_is_idempotent(spark, tmp_path):
    feed = spark.createDataFrame([("n1", T), ("n2", T)], "id string, updated_at timestamp")
    folder, store = f"{tmp_path}/feed", Snapshot(spark, f"file://{tmp_path}/state")
    feed.write.parquet(folder)
    run_stream(feed_stream(spark, folder, feed.schema), store, f"{tmp_path}/ck")
    assert store.table("queue").count() == 2
    version = store.manifest()["version"]
    run_stream(feed_stream(spark, folder, feed.schema), store, f"{tmp_path}/ck2")  # lost offsets: the batches come again
    assert store.manifest()["version"] == version
    spark.createDataFrame([("n3", T)], "id string, updated_at timestamp").write.mode("append").parquet(folder)
    run_stream(feed_stream(spark, folder, feed.schema), store, f"{tmp_path}/ck")
    assert store.table("queue").count() == 3


def test_pages_retries_and_pacing():
    assert [n["id"] for n in paged.pages(service, "/notes", "notes", {}, pacer=paged.Pacer(1e9))] == ["not_0", "not_1", "not_2", "not_3"]
    with pytest.raises(paged.SourceError):
        list(paged.pages(lambda p, q: (200, {}, {"notes": [], "hasMore": True, "cursor": "1"}), "/", "notes", {}, pacer=paged.Pacer(1e9)))
    with pytest.raises(ValueError):
        list(paged.pages(service, "/", "notes", {}, page_size=31))
    slept, answers = [], [(503, {}, {}), (429, {"Retry-After": "7"}, {}), OSError("x"), (200, {}, {"ok": 1})]

    def flaky(path, params):
        a = answers.pop(0)
        if isinstance(a, OSError):
            raise a
        return a

    assert paged.request(flaky, "/", {}, paged.Pacer(1e9), sleep=slept.append) == {"ok": 1} and slept == [1.0, 7.0, 4.0]
    with pytest.raises(paged.SourceError):
        paged.request(lambda p, q: (404, {}, {}), "/", {}, paged.Pacer(1e9), sleep=slept.append)
    now, naps = [0.0], []
    pacer = paged.Pacer(5, clock=lambda: now[0], sleep=naps.append)
    for _ in range(3):
        pacer.wait()
    assert naps == pytest.approx([0.2, 0.4])
    with pytest.raises(paged.SourceError):
        paged.check_summary({**note(1), "extra": 1})
    with pytest.raises(ValueError):
        paged.utc(T)
    with pytest.raises(ValueError):
        paged.get_note(service, "x")


def test_data_source(spark):
    paged.register(spark)
    df = spark.read.format("note_feed").option("transport", "tests.paged_service:service").option("rate", "1000000").load()
    assert sorted(r.id for r in df.collect()) == ["not_0", "not_1", "not_2", "not_3"]


def test_strict_json(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"id": "a", "n": 1}\n')
    assert paged.strict_json(spark, str(path), "id string, n int").collect() == [("a", 1)]
    path.write_text('{"id": "a", "more": 1}\n')
    with pytest.raises(Exception):
        paged.strict_json(spark, str(path), "id string").collect()


def test_strict_json_looks_inside(spark, tmp_path):
    path, schema = tmp_path / "y.jsonl", "id string, owner struct<email:string>, items array<struct<a:int>>"
    path.write_text('{"id": "a", "owner": {"email": "x"}, "items": [{"a": 1}, {}]}\n{"id": "b"}\n')
    assert [r.id for r in paged.strict_json(spark, str(path), schema).collect()] == ["a", "b"]
    for bad in ('{"id": "a", "owner": {"email": "x", "more": 1}}', '{"id": "a", "items": [{"a": 1, "b": 2}]}', "{", "[]"):
        path.write_text(bad + "\n")
        with pytest.raises(Exception):
            paged.strict_json(spark, str(path), schema).collect()


def test_steps_after_an_attempt():
    step = paged.next_step
    assert step((200, {}, {"a": 1}), 0, 4).answer == {"a": 1} and step((404, {}, {}), 0, 4).fault == "status 404"
    assert step((503, {}, {}), 3, 4).wait == 8.0 and step((503, {}, {}), 9, 10).wait == 30.0 and step((503, {"Retry-After": "-2"}, {}), 0, 4).wait == 0.0
    assert step((503, {"Retry-After": "soon"}, {}), 1, 4).wait == 2.0 and step((503, {}, {}), 4, 4).fault == "status 503" and step(OSError("gone"), 4, 4).fault == "gone"
    at = dt.datetime(2026, 1, 2, 3, 4, 5, tzinfo=dt.timezone(dt.timedelta(hours=2)))
    assert paged.utc(at) == "2026-01-02T01:04:05Z" and paged.utc(at.replace(microsecond=7)) == "2026-01-02T01:04:05.000007Z"


def test_filters_and_folders_reach_the_service(spark):
    from pyspark.sql.datasource import EqualTo, GreaterThan, LessThanOrEqual

    reader = paged.NoteFeedReader({"transport": "tests.paged_service:service"})
    at = dt.datetime(2026, 1, 2, tzinfo=dt.timezone.utc)
    asked = [GreaterThan(("updated_at",), at), LessThanOrEqual(("created_at",), at), EqualTo(("id",), "x")]
    assert list(reader.pushFilters(asked)) == asked
    assert reader.params == {"updated_after": "2026-01-02T00:00:00Z", "created_before": "2026-01-02T00:00:00.000001Z"}
    paged.register(spark)
    source = lambda f: spark.read.format(f).option("transport", "tests.paged_service:service").option("rate", "1000000").load()
    assert source("note_feed").filter("updated_at > timestamp '2020-01-01'").count() == 4
    assert {(r.id, r.parent_folder_id) for r in source("folder_feed").collect()} == {("fol_0", None), ("fol_1", "fol_0")}
    got = {r.id: (r.body, r.error) for r in paged.with_details(spark.createDataFrame([("not_1",), ("bad",), ("not_9",)], "id string"), "tests.paged_service:service", rate=1e6).collect()}
    assert json.loads(got["not_1"][0])["id"] == "not_1" and got["bad"][0] is None and got["not_9"][1] == "status 404"


def test_command_line(spark, tmp_path, capsys):
    from notewarp.__main__ import main

    store = f"file://{tmp_path}/cli"
    assert main(["--store", store, "init"]) == 0
    assert main(["--store", store, "status"]) == 0
    assert '"pending": 0' in capsys.readouterr().out
    assert main(["--store", store, "reprocess", "nobody"]) == 2
    with pytest.raises(SystemExit):
        main(["--store", store, "search", "x", "--limit", "0"])
