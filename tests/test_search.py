import math
import sqlite3

import pytest

from notewarp.functions.text import index_tokens, match_expression, query_phrases, snippet_of
from notewarp.operators.search import TextIndex, bm25, fuse, top
from notewarp.plans.search import search

DOCS = [
    (1, "Quarterly budget", "Alex approved the quarterly yoghurt budget."),
    (2, "Plan", "The q3-plan is late: plan q3 again. Budget of the plan"),
    (3, None, ""),
    (4, "Zenning", None),
    (5, "straße", "Émile said snake_case words; budget budget budget"),
    (6, "Quarterly budget", "Alex approved the quarterly yoghurt budget."),
    (None, "budget", "budget"),
]
SCHEMA = "id long, title string, body string"


def fts(query, only=None):
    db = sqlite3.connect(":memory:")
    try:
        db.execute("create virtual table t using fts5(title, body, tokenize='unicode61 remove_diacritics 2')")
    except sqlite3.OperationalError:
        pytest.skip("no full-text module here")
    for i, t, b in DOCS:
        if i is not None:
            db.execute("insert into t(rowid, title, body) values (?, ?, ?)", (i, t or "", b or ""))
    q = match_expression(query)
    return db, (f"{only} : ({q})" if only else q)


@pytest.mark.parametrize("query", ["budget", "quarterly budget", "q3-plan", "plan-q3", "emile", "snake", "nothing", "approved yoghurt"])
@pytest.mark.parametrize("only", [None, "body"])
def test_bm25_equals_sqlite(spark, query, only):
    db, q = fts(query, only)
    want = {i: s for i, s in db.execute("select rowid, bm25(t) from t where t match ?", (q,))}
    docs = spark.createDataFrame(DOCS, SCHEMA)
    got = {r.id: r.bm25 for r in bm25(docs, "id", ["title", "body"], query_phrases(query), only=[only] if only else None).collect()}
    assert got == pytest.approx(want, rel=1e-9)


def test_words_without_letters_match_nothing():
    assert query_phrases("") is None and query_phrases("  ") is None and query_phrases("plan --") is None
    assert query_phrases("q3-plan x") == [["q3", "plan"], ["x"]]
    assert match_expression('a "b') == '"a" AND """b"'
    assert [t for t, _, _ in index_tokens("Öl_x É9")] == ["ol", "x", "e9"]


LONG = " ".join(f"w{i}" for i in range(40)) + " target " + " ".join(f"v{i}" for i in range(40))
TEXTS = [LONG, "target at the start " + LONG, "One. Two words here. " + LONG + ". The target sentence follows here and target again.", "short target text", "q3-plan is one phrase", "a b c target"]


@pytest.mark.parametrize("text", TEXTS)
@pytest.mark.parametrize("query", ["target", "w39 target", "q3-plan"])
def test_snippet_equals_sqlite(text, query):
    db, _ = fts("x")
    db.execute("create virtual table s using fts5(a, b, tokenize='unicode61 remove_diacritics 2')")
    db.execute("insert into s values ('', ?)", (text,))
    row = db.execute("select snippet(s, 1, '[', ']', '…', 24) from s where s match ?", (match_expression(query),)).fetchone()
    if row:
        assert snippet_of(text, query_phrases(query)) == row[0]


def test_stored_index_equals_the_scan(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, SCHEMA)
    index = TextIndex(spark, f"file://{tmp_path}/i")
    index.build(docs, "id", ["title", "body"], buckets=8)
    for query in ("budget", "quarterly budget", "q3-plan", "nothing", ""):
        phrases = query_phrases(query)
        want = {str(r.id): r.bm25 for r in top(bm25(docs, "id", ["title", "body"], phrases), "id", 20).collect()} if phrases else {}
        assert {r.doc: r.bm25 for r in index.search(query).collect()} == pytest.approx(want, rel=1e-9)


def test_unified_search(spark):
    notes = spark.createDataFrame([("n1", "Zenning", "about the launch"), ("n2", "Other", "Zenning is there")], "note_id string, title string, summary string")
    evidence = spark.createDataFrame([("e1", "n2", "", "Zenning customer"), ("e2", "n2", None, "weather")], "evidence_id string, note_id string, note_title string, content string")
    entities = spark.createDataFrame([("c", "company", "Zenning", None), ("p", "product", "Zenning", "Z")], "entity_id string, type_key string, canonical_name string, aliases string")
    got = search(notes, evidence, entities, "zenning").collect()
    assert [(r.kind, r.object_id) for r in got][:3] == [("entity", "c"), ("note", "n1"), ("entity", "p")] or {r.object_id for r in got[:3]} == {"c", "p", "n1"}
    assert {r.group_key for r in got if r.kind == "entity"} == {"entity:company:zenning", "entity:product:zenning"}
    assert [r.title for r in got if r.kind == "evidence"] == ["Untitled meeting"]
    assert search(notes, evidence, entities, " ").collect() == []
    assert {r.object_id for r in search(notes, evidence, entities, "zenning", type_keys=("product",)).collect() if r.kind == "entity"} == {"p"}
    assert len(search(notes, evidence, entities, "zenning", limit=-3).collect()) == 1


def test_fusion_ranks_streams_apart(spark):
    a = spark.createDataFrame([("x", f"o{i}", "t", -1.0) for i in range(3)], "kind string, object_id string, title string, bm25 double")
    b = spark.createDataFrame([("y", "o9", "T  ", -9.0)], "kind string, object_id string, title string, bm25 double")
    got = fuse([a, b], "t", limit=3).collect()
    assert [r.object_id for r in got] == ["o0", "o9", "o1"] and got[0].score == pytest.approx(1 + 1 / 61)


def test_an_updated_index_equals_the_scan_of_what_is_left(spark, tmp_path, monkeypatch):
    from notewarp.operators import search as S

    monkeypatch.setattr(S, "MOST_SEGMENTS", 3)
    index = TextIndex(spark, f"file://{tmp_path}/u")
    assert not index.exists() and index.search("budget").collect() == []
    words = ["budget", "plan", "café", "cafe", "quarterly", "review"]
    now = {f"d{i}": (words[i % 6], " ".join(words[(i * k) % 6] for k in range(1, 5))) for i in range(12)}
    frame = lambda rows: spark.createDataFrame([(k, *v) for k, v in rows.items()], "id string, title string, body string")
    index.build(frame(now), "id", ["title", "body"], buckets=4)

    def check():
        docs = frame(now)
        for query in ("budget", "cafe", "quarterly review", "plan", "gone"):
            want = {r.id: r.bm25 for r in bm25(docs, "id", ["title", "body"], query_phrases(query)).collect()}
            assert {r.doc: r.bm25 for r in index.search(query, limit=None).collect()} == pytest.approx(want, rel=1e-9)
        only = {r.id for r in bm25(docs, "id", ["title", "body"], query_phrases("budget"), only=["title"]).collect()}
        assert {r.doc for r in index.search("budget", only=["title"], limit=None).collect()} == only

    check()
    for step in range(4):
        changed = {f"d{step}": ("plan", "budget budget review"), f"new{step}": ("Café gone", "quarterly review of the plan")}
        lost = [f"d{step + 6}", "never there"] + ([f"new{step - 1}"] if step else [])
        now |= changed
        for k in lost:
            now.pop(k, None)
        index.update(frame(changed), "id", gone=spark.createDataFrame([(k,) for k in lost], "id string"))
        check()
    assert len(index._manifests.read()["segments"]) <= 3
    back = {"d6": ("budget", "again")}
    now |= back
    index.update(frame(back), "id")
    check()


def test_texts_are_tokenized_once(spark):
    from notewarp.plans.search import bm25_phrase

    texts = ["a b a b a", "a a a", "b", "a", "", None, "b a", "x " * 3000 + "a b"]
    docs = spark.createDataFrame([(i, "a b", t) for i, t in enumerate(texts)], SCHEMA)
    for query in ("a-b", "a-a", "a-b-a", "a-b a"):
        phrases = query_phrases(query)
        words = [(t or "").split() for t in texts]
        freq = [[sum(w[k : k + len(p)] == p for k in range(len(w))) for p in phrases] for w in words]
        length = [2 + len(w) for w in words]
        idf = [max(math.log((len(texts) - d + 0.5) / (d + 0.5)), 1e-6) for d in (sum(f[i] > 0 for f in freq) for i in range(len(phrases)))]
        norm = [1.2 * (0.25 + 0.75 * n * len(texts) / sum(length)) for n in length]
        want = {k: -sum(i * x * 2.2 / (x + norm[k]) for i, x in zip(idf, f)) for k, f in enumerate(freq) if all(f)}
        found = bm25(docs, "id", ["title", "body"], phrases, only=["body"])
        assert {r.id: r.bm25 for r in found.collect()} == pytest.approx(want, rel=1e-9)
        # what comes after the statistics reads counts, not texts
        assert "regexp_extract_all" not in found._jdf.queryExecution().optimizedPlan().toString()
    plan = bm25_phrase(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "summary_markdown" not in plan
