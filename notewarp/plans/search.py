"""Search over notes, evidence and entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewarp.functions.scalar import clamp
from notewarp.functions.text import overlap, overlap_words, query_phrases, snippet, tokens
from notewarp.operators.materialize import current_notes
from notewarp.operators.search import DEFAULT_LIMIT, MAX_LIMIT, TextIndex, bm25, empty_results, fuse, top
from notewarp.session import scratch, table


def note_stream(notes: DataFrame, phrases: list[list[str]], limit: int, ranked: DataFrame | None = None) -> DataFrame:
    """Notes (note_id, title, summary) by title and summary; `ranked` (note_id, bm25) comes from an index, else the notes are scanned."""
    best = top(ranked if ranked is not None else bm25(notes, "note_id", ["title", "summary"], phrases), "note_id", limit)
    rows = best.join(notes, "note_id")
    title = F.coalesce("title", F.lit("Untitled meeting"))
    shown = F.coalesce(snippet(phrases)(F.col("summary")), title)
    return rows.select(F.lit("note").alias("kind"), F.col("note_id").alias("object_id"), title.alias("title"), shown.alias("snippet"), "bm25", F.concat_ws(":", F.lit("note"), "note_id").alias("group_key"), F.lit(None).cast("string").alias("type_key"), "note_id")


def evidence_stream(evidence: DataFrame, phrases: list[list[str]], limit: int, ranked: DataFrame | None = None) -> DataFrame:
    """Evidence (evidence_id, note_id, note_title, content) by its content only."""
    best = top(ranked if ranked is not None else bm25(evidence, "evidence_id", ["content"], phrases), "evidence_id", limit)
    rows = best.join(evidence, "evidence_id")
    title = F.coalesce(F.nullif(F.col("note_title"), F.lit("")), F.lit("Untitled meeting"))
    return rows.select(F.lit("evidence").alias("kind"), F.col("evidence_id").alias("object_id"), title.alias("title"), snippet(phrases)(F.col("content")).alias("snippet"), "bm25", F.concat_ws(":", F.lit("evidence"), "note_id").alias("group_key"), F.lit(None).cast("string").alias("type_key"), "note_id")


def entity_stream(entities: DataFrame, phrases: list[list[str]], limit: int, type_keys: tuple[str, ...] = (), ranked: DataFrame | None = None) -> DataFrame:
    """Entities (entity_id, type_key, canonical_name, aliases) by all their names; statistics are over all, the filter comes after."""
    hits = ranked if ranked is not None else bm25(entities, "entity_id", ["canonical_name", "aliases"], phrases)
    found = hits.join(entities.select("entity_id", "type_key", "canonical_name"), "entity_id")
    if type_keys:
        found = found.filter(F.col("type_key").isin(*type_keys))
    rows = found.orderBy("bm25", "entity_id").limit(limit)
    key = F.concat_ws(":", F.lit("entity"), "type_key", F.trim(F.regexp_replace(F.lower("canonical_name"), r"\s+", " ")))
    return rows.select(F.lit("entity").alias("kind"), F.col("entity_id").alias("object_id"), F.col("canonical_name").alias("title"), F.col("canonical_name").alias("snippet"), "bm25", key.alias("group_key"), "type_key", F.lit(None).cast("string").alias("note_id"))


def search(notes: DataFrame, evidence: DataFrame, entities: DataFrame, query: str, *, type_keys: tuple[str, ...] = (), limit: int = DEFAULT_LIMIT, ranked: dict[str, DataFrame] | None = None) -> DataFrame:
    """Unified search: three ranked streams, fused. An empty query reads nothing. `ranked`: kind -> (id, bm25) from stored indexes."""
    phrases = query_phrases(query)
    if phrases is None:
        return empty_results(notes.sparkSession)
    n = clamp(limit, 1, MAX_LIMIT)
    r = ranked or {}
    fused = fuse([entity_stream(entities, phrases, n, type_keys, r.get("entity")), note_stream(notes, phrases, n, r.get("note")), evidence_stream(evidence, phrases, n, r.get("evidence"))], query, limit=n)
    return fused.select("kind", "object_id", "title", "snippet", "score", "group_key", "type_key", "note_id")


def corpora(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Notes, evidence (citations) and entities of the tables."""
    # what isn't searched is not carried through the choice of the current row
    details = table(spark, root, "notes").select("id", "updated_at", "detail_no", "title", "summary_text")
    notes = current_notes(details).select(F.col("id").alias("note_id"), "title", F.col("summary_text").alias("summary"))
    evidence = table(spark, root, "citations").select("evidence_id", "note_id", "note_title", F.col("excerpt").alias("content"))
    evidence = evidence.groupBy("evidence_id").agg(F.min_by(F.struct("note_id", "note_title", "content"), F.struct("note_id", "content")).alias("e")).select("evidence_id", "e.*")
    entities = table(spark, root, "entities").filter("status = 'active'")
    entities = entities.select(F.concat_ws("#", "entity_id", F.col("record_id").cast("string")).alias("entity_id"), "type_key", "canonical_name", F.array_join("aliases", " ").alias("aliases"))
    return notes, evidence, entities


def bm25_documents(spark: SparkSession, root: str) -> DataFrame:
    """The best hundred documents for two words."""
    docs = table(spark, root, "documents").select("doc_id", "text", "title")
    return top(bm25(docs, "doc_id", ["title", "text"], query_phrases("vendor shortlist")), "doc_id", 100).select("doc_id", F.round("bm25", 9).alias("bm25"))


def bm25_phrase(spark: SparkSession, root: str) -> DataFrame:
    """Notes with a phrase of adjacent words."""
    notes, _, _ = corpora(spark, root)
    return bm25(notes, "note_id", ["title", "summary"], query_phrases("hand-over checklist"), only=["summary"]).select("note_id", F.round("bm25", 9).alias("bm25"))


def search_unified(spark: SparkSession, root: str) -> DataFrame:
    """Unified search for two words, without the snippets."""
    return search(*corpora(spark, root), "travel policy", limit=50).select("kind", "object_id", "title", F.round("score", 9).alias("score"), "group_key")


def search_entities(spark: SparkSession, root: str) -> DataFrame:
    """Entities of one type by name."""
    _, _, entities = corpora(spark, root)
    return entity_stream(entities, query_phrases("alexander"), 100, ("person",)).select("object_id", "title", F.round("bm25", 9).alias("bm25"), "group_key")


def search_snippets(spark: SparkSession, root: str) -> DataFrame:
    """Notes found with their snippets."""
    return note_stream(corpora(spark, root)[0], query_phrases("risk register"), 20).select("object_id", "title", "snippet")


def search_accents(spark: SparkSession, root: str) -> DataFrame:
    """Documents with a word that has an accent in the text and none in the query."""
    docs = table(spark, root, "documents").select("doc_id", "text", "title")
    return bm25(docs, "doc_id", ["title", "text"], query_phrases("réunion")).select("doc_id", F.round("bm25", 9).alias("bm25"))


def search_indexed(spark: SparkSession, root: str) -> DataFrame:
    """Notes with two phrases, by a stored index: built from the first rows of the notes, updated by the current rows, blank ones removed."""
    rows = table(spark, root, "notes").filter("id is not null")
    first = rows.groupBy(F.col("id").alias("note_id")).agg(F.min_by(F.struct("title", F.col("summary_text").alias("summary")), F.struct("updated_at", "detail_no")).alias("n")).select("note_id", "n.*")
    now = corpora(spark, root)[0]
    index = TextIndex(spark, scratch(spark))
    index.build(first, "note_id", ["title", "summary"], buckets=16)
    blank = F.trim(F.coalesce("summary", F.lit(""))) == ""
    index.update(now.filter(~blank).join(first, ["note_id", "title", "summary"], "left_anti"), "note_id", gone=now.filter(blank).select("note_id"))
    return index.search("risk register", limit=None).select(F.col("doc").alias("note_id"), F.round("bm25", 9).alias("bm25"))


def term_statistics(spark: SparkSession, root: str) -> DataFrame:
    """Documents and occurrences of the words in at least a tenth of all documents."""
    docs = table(spark, root, "documents").filter("text is not null").select("doc_id", F.explode(tokens(F.col("text"))).alias("term"))
    per_doc = docs.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    terms = per_doc.groupBy("term").agg(F.count("*").alias("docs"), F.sum("tf").alias("occurrences"))
    total = table(spark, root, "documents").filter("text is not null").count()
    return terms.filter(F.col("docs") * 10 >= total)


def overlap_pairs(spark: SparkSession, root: str) -> DataFrame:
    """Words that a citation shares with the title of its note."""
    c = table(spark, root, "citations")
    return c.select("citation_no", overlap(overlap_words(F.col("excerpt")), overlap_words(F.coalesce("note_title", F.lit("")))).cast("long").alias("shared"))


QUERIES = {
    "bm25_documents": bm25_documents,
    "bm25_phrase": bm25_phrase,
    "search_unified": search_unified,
    "search_entities": search_entities,
    "search_snippets": search_snippets,
    "search_accents": search_accents,
    "search_indexed": search_indexed,
    "term_statistics": term_statistics,
    "overlap_words": overlap_pairs,
}


def _tok(expr: str) -> str:
    return f"coalesce(regexp_extract_all(strip_accents(lower({expr})), '[\\p{{L}}\\p{{N}}]+'), [])"


def _count(words: str, phrase: list[str]) -> str:
    if len(phrase) == 1:
        return f"len(list_filter({words}, lambda t: t = '{phrase[0]}'))"
    n = len(phrase)
    return f"len(list_filter(range(1, greatest(1, len({words}) - {n - 2})), lambda i: {words}[i:i+{n - 1}] = {phrase!r}))"


def _bm25_sql(source: str, key: str, columns: list[str], phrases: list[list[str]], only: list[str] | None = None) -> str:
    """CTEs t and r: r has (key, bm25)."""
    toks = ", ".join(f"{_tok(c)} AS t_{c}" for c in columns)
    freq = ", ".join(f"{' + '.join(_count(f't_{c}', p) for c in (only or columns))} AS f{i}" for i, p in enumerate(phrases))
    length = " + ".join(f"len(t_{c})" for c in columns)
    idf = lambda i: f"greatest(ln(((SELECT n FROM st) - (SELECT d{i} FROM st) + 0.5) / ((SELECT d{i} FROM st) + 0.5)), 1e-6)"
    score = " + ".join(f"{idf(i)} * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * length / (SELECT a FROM st)))" for i in range(len(phrases)))
    return f"""tk AS (SELECT {key}, {toks} FROM {source} WHERE {key} IS NOT NULL),
t AS (SELECT {key}, {length} AS length, {freq} FROM tk),
st AS (SELECT count(*) AS n, sum(length) / count(*) AS a, {', '.join(f'count(*) FILTER (WHERE f{i} > 0) AS d{i}' for i in range(len(phrases)))} FROM t),
r AS (SELECT {key}, -({score}) AS bm25 FROM t WHERE {' AND '.join(f'f{i} > 0' for i in range(len(phrases)))})"""


_NOTES = "n AS (SELECT id AS note_id, arg_max({'title': title, 's': summary_text}, (updated_at, detail_no)) AS x FROM notes GROUP BY 1), nn AS (SELECT note_id, x.title AS title, x.s AS summary FROM n)"
_EV = "ee AS (SELECT evidence_id, min(row(note_id, excerpt, note_title)) AS m FROM citations GROUP BY 1), ev AS (SELECT evidence_id, m[1] AS note_id, m[2] AS content, m[3] AS note_title FROM ee)"
_EN = "en AS (SELECT entity_id || '#' || record_id AS entity_id, type_key, canonical_name, array_to_string(aliases, ' ') AS aliases FROM entities WHERE status = 'active')"


def _renamed(sql: str, tag: str) -> str:
    import re

    return re.sub(r"\b(tk|t|st|r)\b(?= AS \()|(?<=FROM )(tk|t|st|r)\b", lambda m: (m.group(1) or m.group(2)) + tag, sql)


_Q = [["travel"], ["policy"]]
_UNIFIED = f"""WITH {_NOTES}, {_EV}, {_EN},
{_renamed(_bm25_sql('nn', 'note_id', ['title', 'summary'], _Q), '_n')},
{_renamed(_bm25_sql('ev', 'evidence_id', ['content'], _Q), '_e')},
{_renamed(_bm25_sql('en', 'entity_id', ['canonical_name', 'aliases'], _Q), '_x')},
s AS (
  SELECT * FROM (SELECT 'note' AS kind, note_id AS object_id, coalesce(title, 'Untitled meeting') AS title, bm25, 'note:' || note_id AS group_key FROM r_n JOIN nn USING (note_id) ORDER BY bm25, object_id LIMIT 50)
  UNION ALL SELECT * FROM (SELECT 'evidence', evidence_id, coalesce(nullif(note_title, ''), 'Untitled meeting'), bm25, 'evidence:' || note_id FROM r_e JOIN ev USING (evidence_id) ORDER BY 4, 2 LIMIT 50)
  UNION ALL SELECT * FROM (SELECT 'entity', entity_id, canonical_name, bm25, 'entity:' || type_key || ':' || trim(regexp_replace(lower(canonical_name), '\\s+', ' ', 'g')) FROM r_x JOIN en USING (entity_id) ORDER BY 4, 2 LIMIT 50)),
k AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY bm25, object_id) AS rank FROM s)
SELECT kind, object_id, title, round(CASE WHEN trim(regexp_replace(lower(title), '\\s+', ' ', 'g')) = 'travel policy' THEN 1.0 ELSE 0.0 END + 1.0::DOUBLE / (60 + rank), 9) AS score, group_key
FROM k ORDER BY score DESC, kind, object_id LIMIT 50"""

ORACLE = {
    "bm25_documents": f"WITH {_bm25_sql('documents', 'doc_id', ['title', 'text'], [['vendor'], ['shortlist']])} SELECT doc_id, round(bm25, 9) AS bm25 FROM r ORDER BY r.bm25, doc_id LIMIT 100",
    "bm25_phrase": f"WITH {_NOTES}, {_bm25_sql('nn', 'note_id', ['title', 'summary'], [['hand', 'over'], ['checklist']], ['summary'])} SELECT note_id, round(bm25, 9) AS bm25 FROM r",
    "search_unified": _UNIFIED,
    "search_entities": f"WITH {_EN}, {_bm25_sql('en', 'entity_id', ['canonical_name', 'aliases'], [['alexander']])} SELECT entity_id AS object_id, canonical_name AS title, round(bm25, 9) AS bm25, 'entity:' || type_key || ':' || trim(regexp_replace(lower(canonical_name), '\\s+', ' ', 'g')) AS group_key FROM r JOIN en USING (entity_id) WHERE type_key = 'person' ORDER BY r.bm25, entity_id LIMIT 100",
    "search_accents": f"WITH {_bm25_sql('documents', 'doc_id', ['title', 'text'], [['reunion']])} SELECT doc_id, round(bm25, 9) AS bm25 FROM r",
    "search_indexed": f"WITH {_NOTES}, live AS (SELECT * FROM nn WHERE trim(coalesce(summary, '')) <> ''), {_bm25_sql('live', 'note_id', ['title', 'summary'], [['risk'], ['register']])} SELECT note_id, round(bm25, 9) AS bm25 FROM r",
    "term_statistics": f"WITH w AS (SELECT doc_id, unnest({_tok('text')}) AS term FROM documents), p AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY 1, 2) SELECT term, count(*) AS docs, CAST(sum(tf) AS BIGINT) AS occurrences FROM p GROUP BY 1 HAVING count(*) * 10 >= (SELECT count(*) FROM documents WHERE text IS NOT NULL)",
    "overlap_words": """WITH w AS (SELECT citation_no, list_distinct(list_filter(regexp_extract_all(lower(excerpt), '[\\p{L}\\p{N}_]+'), lambda t: length(t) >= 3)) AS a, list_distinct(list_filter(regexp_extract_all(lower(coalesce(note_title, '')), '[\\p{L}\\p{N}_]+'), lambda t: length(t) >= 3)) AS b FROM citations)
SELECT citation_no, CAST(len(list_intersect(a, b)) AS BIGINT) AS shared FROM w""",
}
