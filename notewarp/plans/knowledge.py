"""Queries over notes, evidence, queue, ontology and entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewarp.functions import scalar as S
from notewarp.functions.text import normalize_text, squeeze
from notewarp.operators import ontology as O
from notewarp.operators.context import evidence_context, ontology_context
from notewarp.operators.materialize import current_notes, flat_notes, refresh_evidence, segment_units, summary_units
from notewarp.operators.merge import flag_where, hide_missing, insert_or_ignore, upsert
from notewarp.operators.resolve import identifier_value, resolve
from notewarp.session import cut, table
from notewarp.streaming import queue as Q

_AT = "2026-09-06 09:00:00"


def evidence(spark: SparkSession, root: str) -> DataFrame:
    """Evidence units of the current notes and of all segments."""
    return summary_units(current_notes(table(spark, root, "notes"))).unionByName(segment_units(table(spark, root, "transcript_segments")), allowMissingColumns=True)


def evidence_units(spark: SparkSession, root: str) -> DataFrame:
    """Content-addressed ids of all units; blank ones are left out."""
    return evidence(spark, root).select("evidence_id", "note_id", "unit_kind", "unit_index", "content_hash")


def notes_flat(spark: SparkSession, root: str) -> DataFrame:
    """Notes as rows, folders as text."""
    n = flat_notes(current_notes(table(spark, root, "notes")))
    return n.select("note_id", "title", "owner_name", "owner_email", "calendar_event_id", F.unix_micros(F.col("updated_at").cast("timestamp")).alias("updated_us"), F.array_join("folder_ids", ",").alias("folder_ids"))


def attendees(spark: SparkSession, root: str) -> DataFrame:
    """Nested attendees as rows with their place, those without a name left out but counted."""
    rows = current_notes(table(spark, root, "notes")).select("id", F.posexplode("attendees").alias("place", "a"))
    return rows.filter("trim(a.name) <> ''").select(F.col("id").alias("note_id"), F.col("place").cast("long").alias("place"), F.col("a.name").alias("name"), F.col("a.email").alias("email"))


def first_summary(spark: SparkSession, root: str) -> DataFrame:
    """First active summary of each note."""
    e = evidence(spark, root).filter("unit_kind = 'summary' and is_active")
    return e.groupBy("note_id").agg(F.min_by("content", F.struct("unit_index", "evidence_id")).alias("content")).withColumnRenamed("content", "summary")


def evidence_refreshed(spark: SparkSession, root: str) -> DataFrame:
    """Evidence of earlier rows goes to sleep when the current rows are materialised: units by state."""
    details = table(spark, root, "notes")
    old = summary_units(details.select("id", "summary_text")).dropDuplicates(["evidence_id"])
    now = current_notes(details)
    return refresh_evidence(old, summary_units(now), now.select(F.col("id").alias("note_id"))).select("evidence_id", "note_id", "is_active")


def context(spark: SparkSession, root: str) -> DataFrame:
    """What is shown of every note within the budget of characters; sizes instead of texts."""
    notes = current_notes(table(spark, root, "notes")).select(F.col("id").alias("note_id"), "title")
    got = evidence_context(evidence(spark, root), notes)
    return got.select("note_id", "place", "evidence_id", F.char_length("content").cast("long").alias("size"))


def _types(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    e, x = table(spark, root, "entities"), table(spark, root, "extracted_entities")
    types = e.select("type_key").unionByName(x.select("type_key")).distinct()
    types = types.select("type_key", F.initcap("type_key").alias("display_name"), F.concat(F.lit("a "), F.col("type_key")).alias("description"), F.lit("global").alias("identity_scope"), F.lit(1).alias("created_revision"), F.lit(1).alias("updated_revision"), F.col("type_key").isin("meeting", "person").alias("is_seed"))
    fields = e.select("type_key", F.explode("identifiers.field_key").alias("field_key")).distinct()
    fields = fields.select("type_key", "field_key", F.initcap("field_key").alias("display_name"), F.lit("").alias("description"), F.lit("string").alias("data_type"), F.lit(True).alias("is_identifier"), F.lit(1).alias("created_revision"))
    return types, fields


_CONTEXT = "Company strategy: an organisation and its topic"


def _relations(spark: SparkSession, root: str) -> DataFrame:
    """A relation from persons to every other type, and one from every type to itself."""
    types, _ = _types(spark, root)
    to = types.select(F.concat(F.lit("of_"), F.col("type_key")).alias("relation_key"), F.lit("person").alias("source_type_key"), F.col("type_key").alias("target_type_key"))
    same = types.select(F.concat(F.lit("like_"), F.col("type_key")).alias("relation_key"), F.col("type_key").alias("source_type_key"), F.col("type_key").alias("target_type_key"))
    return to.unionByName(same).select("relation_key", F.lit("").alias("display_name"), F.lit("").alias("description"), "source_type_key", "target_type_key", F.lit(True).alias("is_directed"), F.lit(1).alias("created_revision"))


def ontology_rows(spark: SparkSession, root: str) -> DataFrame:
    """Types with their fields, seeds first, then by the words shared with a context."""
    types, fields = _types(spark, root)
    shown, _ = ontology_context(types, fields, _relations(spark, root), _CONTEXT)
    return shown.select("type_key", "field_key", "is_seed", F.col("shared").cast("long").alias("shared"))


def ontology_relations(spark: SparkSession, root: str) -> DataFrame:
    """Relations between types that are shown when only six rows of types are."""
    types, fields = _types(spark, root)
    return ontology_context(types, fields, _relations(spark, root), _CONTEXT, rows=6)[1].select("relation_key", "source_type_key", "target_type_key")


def type_equivalence(spark: SparkSession, root: str) -> DataFrame:
    """Canonical key of every type key when those of the graph exist."""
    types, _ = _types(spark, root)
    return O.canonical_keys(types, types, spark.createDataFrame([], O.ALIASES))


def missing_evidence(spark: SparkSession, root: str) -> DataFrame:
    """Evidence that extracted entities cite and their note hasn't got."""
    have = table(spark, root, "citations").select("note_id", "evidence_id", F.lit(True).alias("is_active"))
    gone = O.missing_evidence(table(spark, root, "extracted_entities").select("note_id", "evidence_ids"), have)
    return gone.select("note_id", F.array_join("missing", ",").alias("missing"))


def undeclared_fields(spark: SparkSession, root: str) -> DataFrame:
    """Identifier fields of extracted entities that the seed of the ontology doesn't declare."""
    used = table(spark, root, "extracted_entities").select("type_key", F.explode("identifiers.field_key").alias("field_key"))
    return O.undeclared_fields(used, O.seed(spark)["field_definitions"], identifiers=True)


def wrong_endpoints(spark: SparkSession, root: str) -> DataFrame:
    """Relations between other types than declared: everybody `attended` the note's meeting, every company of a note `employs` its persons,
    and its first person `knows` the rest, which isn't declared."""
    x = table(spark, root, "extracted_entities").select(F.concat(F.lit("x:"), F.col("record_id").cast("string")).alias("entity_id"), "record_id", "type_key", "note_id")
    first = x.groupBy("note_id").agg(F.min_by("entity_id", "record_id").alias("first"))
    attended = x.select(F.col("entity_id").alias("source"), F.lit("attended").alias("relation_key"), F.col("note_id").alias("target"))
    employs = x.join(first, "note_id").select(F.col("first").alias("source"), F.lit("employs").alias("relation_key"), F.col("entity_id").alias("target"))
    knows = x.join(first, "note_id").filter("type_key = 'person'").select(F.col("entity_id").alias("source"), F.lit("knows").alias("relation_key"), F.col("first").alias("target"))
    ends = x.select("entity_id", "type_key").unionByName(x.select(F.col("note_id").alias("entity_id"), F.lit("meeting").alias("type_key")).distinct())
    declared = spark.createDataFrame([*O.SEED_RELATIONS, ("employs", "employs", "", "company", "person", True, 1)], O.RELATIONS)
    return O.wrong_endpoints(attended.unionByName(employs).unionByName(knows), ends, declared)


def identifier_matches(spark: SparkSession, root: str) -> DataFrame:
    """Extracted entities and the entities under their identifiers: the id where there is one, the count where there are more."""
    known = table(spark, root, "entities").filter("status = 'active'").select("entity_id", "type_key", F.explode("identifiers").alias("i"))
    known = known.select("type_key", F.col("i.field_key").alias("field_key"), F.lower(F.trim("i.raw_value")).alias("value"), "entity_id")
    asked = table(spark, root, "extracted_entities").select("record_id", "type_key", F.explode("identifiers").alias("i")).select("record_id", "type_key", F.col("i.field_key").alias("field_key"), F.lower(F.trim("i.value")).alias("value"))
    hits = asked.join(known, ["type_key", "field_key", "value"]).groupBy("record_id").agg(F.count_distinct("entity_id").alias("n"), F.min("entity_id").alias("entity_id"))
    return hits.select("record_id", "n", F.when(F.col("n") == 1, F.col("entity_id")).alias("entity_id"))


def name_matches(spark: SparkSession, root: str) -> DataFrame:
    """Extracted entities and the one entity of the type with that name, or else with that alias."""
    e = table(spark, root, "entities").filter("status = 'active'")
    names = e.select("type_key", squeeze(F.col("canonical_name")).alias("name"), "entity_id").groupBy("type_key", "name").agg(F.count("*").alias("n"), F.min("entity_id").alias("by_name"))
    aliases = e.select("type_key", F.explode("aliases").alias("a"), "entity_id").groupBy("type_key", squeeze(F.col("a")).alias("name")).agg(F.count_distinct("entity_id").alias("n"), F.min("entity_id").alias("by_alias"))
    x = table(spark, root, "extracted_entities").select("record_id", "type_key", squeeze(F.col("name")).alias("name"))
    joined = x.join(names.filter("n = 1").drop("n"), ["type_key", "name"], "left").join(aliases.filter("n = 1").drop("n"), ["type_key", "name"], "left")
    source = F.when(F.col("by_name").isNotNull(), "exact_name").when(F.col("by_alias").isNotNull(), "exact_alias").otherwise("created")
    return joined.select("record_id", F.coalesce("by_name", "by_alias").alias("entity_id"), source.alias("match_source"))


def _stored(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The entities of the tables as a stored graph; a real entity may have several rows."""
    e = table(spark, root, "entities")
    return {
        "entities": e.groupBy("entity_id").agg(F.min_by(F.struct("type_key", "canonical_name", "status"), "record_id").alias("e")).select("entity_id", "e.*"),
        "entity_aliases": e.select("entity_id", F.explode("aliases").alias("alias")),
        "entity_identifiers": e.select("entity_id", F.explode("identifiers").alias("i")).select("entity_id", F.col("i.field_key").alias("field_key"), identifier_value(F.col("i.raw_value")).alias("normalized_value")),
    }


def resolved(spark: SparkSession, root: str) -> DataFrame:
    """(record_id, entity_id, match_source) of every extracted entity that something stored decides, against the stored entities."""
    c = table(spark, root, "extracted_entities").select(F.col("record_id").alias("candidate_no"), "type_key", "name", F.lit(None).cast("string").alias("note_id"), F.lit(None).cast("string").alias("scope_note_id"), "identifiers")
    known = _stored(spark, root)
    ids = known["entities"].select("entity_id", F.lit(True).alias("stored"))
    got = resolve(c, known).join(ids, "entity_id", "left").filter("stored or match_source = 'conflict'")
    return got.select(F.col("candidate_no").alias("record_id"), "entity_id", "match_source")


def resolved_new(spark: SparkSession, root: str) -> DataFrame:
    """(record_id, first_id) of every extracted entity resolved among themselves: the record that created its entity; conflicts left out."""
    c = table(spark, root, "extracted_entities").select(F.col("record_id").alias("candidate_no"), "type_key", "name", F.lit(None).cast("string").alias("note_id"), F.lit(None).cast("string").alias("scope_note_id"), "identifiers")
    got = cut(resolve(c)).filter("entity_id is not null")
    return got.select(F.col("candidate_no").alias("record_id"), "entity_id").join(got.groupBy("entity_id").agg(F.min("candidate_no").alias("first_id")), "entity_id").select("record_id", "first_id")


def alias_lists(spark: SparkSession, root: str) -> DataFrame:
    """Aliases of each entity in one line."""
    a = table(spark, root, "entities").select("entity_id", F.explode("aliases").alias("alias")).distinct()
    return a.groupBy("entity_id").agg(F.array_join(F.array_sort(F.collect_list("alias")), " ").alias("aliases"))


def aliases_inserted(spark: SparkSession, root: str) -> DataFrame:
    """Aliases (type, alias) after those of extracted names were inserted or ignored."""
    e = table(spark, root, "entities").select("type_key", F.explode("aliases").alias("alias")).select("type_key", squeeze(F.col("alias")).alias("alias")).groupBy("type_key", "alias").agg(F.lit("entities").alias("origin"))
    x = table(spark, root, "extracted_entities").select("type_key", squeeze(F.col("name")).alias("alias"), F.lit("extracted").alias("origin"))
    return insert_or_ignore(e, x, ["type_key", "alias"])


def duplicate_keys(spark: SparkSession, root: str) -> DataFrame:
    """Local ids that a note has twice or that aren't snake case."""
    return O.bad_keys(table(spark, root, "extracted_entities").select(F.concat_ws("_", "type_key", "local_id").alias("k")), "k")


def queue_state(spark: SparkSession, root: str) -> DataFrame:
    """The present state of every note's queue row."""
    q = Q.newest_rows(table(spark, root, "processing_queue"))
    for c in ("remote_updated_at", "queued_at", "updated_at"):
        q = q.withColumn(c, F.col(c).cast("timestamp"))
    return q.drop("queue_seq")


def queue_counts(spark: SparkSession, root: str) -> DataFrame:
    """Notes by state, zero-filled."""
    return Q.counts(queue_state(spark, root))


def ingestion_status(spark: SparkSession, root: str) -> DataFrame:
    """Watermark and counts in one row."""
    wide = queue_counts(spark, root).groupBy(F.lit(1).alias("one")).pivot("state", Q.STATES).agg(F.max("n"))
    mark = table(spark, root, "sync_state").agg(F.max("watermark").alias("w")).select(F.unix_micros(F.col("w").cast("timestamp")).alias("watermark_us"), F.lit(1).alias("one"))
    return wide.join(F.broadcast(mark), "one").drop("one")


def queue_claimable(spark: SparkSession, root: str) -> DataFrame:
    """The hundred oldest rows that may be claimed."""
    return Q.claimable(queue_state(spark, root), limit=100).select("note_id", "state", "attempts")


def queue_claimed(spark: SparkSession, root: str) -> DataFrame:
    """State and attempts of every note after everything claimable was claimed."""
    q, _ = Q.claim(queue_state(spark, root), now=_AT)
    return q.select("note_id", "state", "attempts")


def queue_recovered(spark: SparkSession, root: str) -> DataFrame:
    """State of every note after interrupted rows were recovered."""
    return Q.recover(queue_state(spark, root)).select("note_id", "state")


def queue_reprocessed(spark: SparkSession, root: str) -> DataFrame:
    """State of every note after those with a version since the mark were queued again."""
    feed = table(spark, root, "note_feed")
    last = feed.filter("id is not null").groupBy(F.col("id").alias("note_id")).agg(F.max("updated_at").alias("at")).filter("at >= timestamp_ntz '2026-07-15 09:00:00'")
    return Q.reprocess(queue_state(spark, root), last).select("note_id", "state", "attempts", "force_reprocess")


def queue_discovered(spark: SparkSession, root: str) -> DataFrame:
    """The queue after the whole feed was discovered."""
    feed = table(spark, root, "note_feed").select("id", F.col("updated_at").cast("timestamp").alias("updated_at"))
    q = Q.discover(queue_state(spark, root), feed, now=_AT)
    return q.select("note_id", F.unix_micros("remote_updated_at").alias("version_us"), "state", "attempts", "force_reprocess")


def feed_after_mark(spark: SparkSession, root: str) -> DataFrame:
    """Rows of the feed after the last complete pass, and the mark they lead to."""
    feed = table(spark, root, "note_feed")
    state = table(spark, root, "sync_state")
    key = state.first()["source_key"]
    new = Q.after_mark(feed, state, key)
    return new.agg(F.count("*").alias("n"), F.count_distinct("id").alias("notes"), F.unix_micros(F.max("updated_at").cast("timestamp")).alias("mark_us"))


def notes_upserted(spark: SparkSession, root: str) -> DataFrame:
    """Notes after the newest feed rows were merged: title and time are refreshed, created_at and address stay."""
    old = current_notes(table(spark, root, "notes")).select(F.col("id").alias("note_id"), "title", "created_at", "updated_at", "web_url")
    feed = table(spark, root, "note_feed").select(F.col("id").alias("note_id"), "title", "created_at", "updated_at", "feed_seq")
    merged = upsert(old, feed.filter("note_id is not null"), ["note_id"], keep=["created_at"], order=["updated_at", "feed_seq"])
    return merged.select("note_id", "title", F.unix_micros(F.col("created_at").cast("timestamp")).alias("created_us"), F.unix_micros(F.col("updated_at").cast("timestamp")).alias("updated_us"), "web_url")


def notes_hidden(spark: SparkSession, root: str) -> DataFrame:
    """Visibility of every note after a full listing that lacks those whose newest feed row has no title."""
    notes = flat_notes(current_notes(table(spark, root, "notes"))).select("note_id", "visibility")
    feed = table(spark, root, "note_feed").groupBy(F.col("id").alias("note_id")).agg(F.max_by("title", F.struct("updated_at", "feed_seq")).alias("title")).filter("title is not null")
    return hide_missing(notes, feed)


def facts_retired(spark: SparkSession, root: str) -> DataFrame:
    """Citations whose note has a later version in the feed than in the queue become inactive."""
    facts = table(spark, root, "citations").select("citation_no", "note_id", F.lit(True).alias("is_active"))
    feed = table(spark, root, "note_feed").groupBy(F.col("id").alias("note_id")).agg(F.max("updated_at").alias("v"))
    seen = table(spark, root, "processing_queue").groupBy("note_id").agg(F.max("remote_updated_at").alias("q"))
    stale = feed.join(seen, "note_id", "left").filter("q is null or q < v").select("note_id")
    return flag_where(facts, stale, "note_id", "is_active", F.lit(False))


def changed_notes(spark: SparkSession, root: str) -> DataFrame:
    """Notes of the feed that are unseen or newer than the row that was stored first."""
    stored = table(spark, root, "notes").groupBy(F.col("id").alias("note_id")).agg(F.min("updated_at").alias("known"))
    feed = table(spark, root, "note_feed").groupBy(F.col("id").alias("note_id")).agg(F.max("updated_at").alias("newest"))
    kind = F.when(F.col("known").isNull(), "unseen").otherwise("newer")
    return feed.join(stored, "note_id", "left").filter("known is null or known < newest").select("note_id", kind.alias("change"))


def sync_report(spark: SparkSession, root: str) -> DataFrame:
    """Counters of a pass: rows, notes, late and redelivered rows."""
    f = table(spark, root, "note_feed")
    per = f.groupBy("id", "updated_at").agg(F.count("*").alias("n"), F.min("feed_seq").alias("first"))
    return per.agg(F.sum("n").cast("long").alias("rows"), F.count("*").alias("versions"), F.count_distinct("id").alias("notes"), F.count_if(F.col("n") > 1).alias("redelivered"))


def identities(spark: SparkSession, root: str) -> DataFrame:
    """Name-based ids, digests, group keys and labels of the entities."""
    e = table(spark, root, "entities")
    return e.select(
        "record_id",
        S.uuid5(F.concat(F.lit("entity:"), F.col("entity_id"))).alias("id5"),
        S.digest(F.col("canonical_name")).alias("digest"),
        S.group_key(F.lit("entity"), F.col("type_key"), squeeze(F.col("canonical_name"))).alias("group_key"),
        S.label(F.col("canonical_name")).alias("label"),
        S.estimated_tokens(F.col("canonical_name")).cast("long").alias("tokens"),
        S.is_key(F.col("type_key")).alias("is_key"),
        S.iso_utc(F.col("created_at").cast("timestamp")).alias("created"),
    )


def normal_forms(spark: SparkSession, root: str) -> DataFrame:
    """Names in their stored form (full case folding, composed); checked against Python, not SQL."""
    return table(spark, root, "entities").select("record_id", normalize_text(F.col("canonical_name")).alias("name"))


def graph_layout(spark: SparkSession, root: str) -> DataFrame:
    """Place and colour of the nations in the explorer."""
    n = table(spark, root, "nation").select("n_nationkey", "n_name")
    x, y = S.circle_layout(F.col("n_nationkey"), F.lit(25))
    return n.select(F.col("n_nationkey").cast("long").alias("n_nationkey"), S.palette_index(F.col("n_name"), 8).cast("long").alias("colour"), F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


def filtered_nodes(spark: SparkSession, root: str) -> DataFrame:
    """Entities whose name or type contains a term, whatever the case."""
    e = table(spark, root, "entities")
    return e.filter(F.lower(F.concat_ws(" ", "canonical_name", "type_key")).contains("son")).select("record_id", "canonical_name", "type_key")


def type_list(spark: SparkSession, root: str) -> DataFrame:
    """Types with the number of their entities and fields."""
    types, fields = _types(spark, root)
    n = table(spark, root, "entities").groupBy("type_key").agg(F.count("*").alias("entities"))
    f = fields.groupBy("type_key").agg(F.count("*").alias("fields"))
    return types.join(n, "type_key", "left").join(f, "type_key", "left").select("type_key", F.coalesce("entities", F.lit(0)).alias("entities"), F.coalesce("fields", F.lit(0)).alias("fields"))


_NAMES = (
    "evidence_units notes_flat attendees first_summary evidence_refreshed context ontology_rows ontology_relations type_equivalence missing_evidence undeclared_fields wrong_endpoints identifier_matches name_matches resolved resolved_new "
    "alias_lists aliases_inserted duplicate_keys queue_counts ingestion_status queue_claimable queue_claimed queue_recovered queue_reprocessed queue_discovered feed_after_mark notes_upserted notes_hidden "
    "facts_retired changed_notes sync_report identities normal_forms graph_layout filtered_nodes type_list"
).split()
QUERIES = {("evidence_context" if n == "context" else n): globals()[n] for n in _NAMES}

_N = "n0 AS (SELECT id, arg_max({'title': title, 's': summary_text, 'oname': owner.name, 'oemail': owner.email, 'cal': calendar_event.calendar_event_id, 'u': updated_at, 'c': created_at, 'f': folder_membership, 'a': attendees, 'w': web_url}, (updated_at, detail_no)) AS x FROM notes GROUP BY 1)"
_STRIP = "regexp_replace({}, '^[\\s\\x{{00A0}}]+|[\\s\\x{{00A0}}]+$', '', 'g')"
_S, _T = _STRIP.format("x.s"), _STRIP.format("text")
_E = f"""e0 AS (SELECT id AS note_id, 'summary' AS unit_kind, CAST(0 AS BIGINT) AS unit_index, {_S} AS content FROM n0
      UNION ALL SELECT note_id, 'transcript', segment_id, {_T} FROM transcript_segments),
e AS (SELECT *, sha256(content) AS content_hash FROM e0 WHERE content <> ''),
ev AS (SELECT 'ev_' || substr(sha256(note_id || ':' || unit_kind || ':' || unit_index || ':' || content_hash), 1, 32) AS evidence_id, * FROM e)"""
_Q0 = "q0 AS (SELECT note_id, arg_max({'s': state, 'a': attempts, 'f': force_reprocess, 'v': remote_updated_at, 'q': queued_at, 'u': updated_at}, queue_seq) AS x FROM processing_queue GROUP BY 1), q AS (SELECT note_id, x.s AS state, x.a AS attempts, x.f AS force_reprocess, x.v AS remote_updated_at, x.q AS queued_at, x.u AS updated_at FROM q0)"
_SQ = "trim(regexp_replace(lower({}), '\\s+', ' ', 'g'))"
_WORDS = "list_distinct(list_filter(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+'), lambda t: length(t) >= 3))"
_FIELDS = "fd AS (SELECT DISTINCT type_key, unnest(list_transform(identifiers, lambda i: i.field_key)) AS field_key FROM entities)"
_TYPES = "ty AS (SELECT DISTINCT type_key FROM (SELECT type_key FROM entities UNION ALL SELECT type_key FROM extracted_entities))"

_STORE = """act AS (SELECT entity_id, arg_min(type_key, record_id) AS type_key, arg_min(canonical_name, record_id) AS canonical_name FROM entities GROUP BY 1 HAVING arg_min(status, record_id) = 'active'),
si AS (SELECT act.entity_id, act.type_key, x.i.field_key AS f, lower(trim(x.i.raw_value)) AS v FROM (SELECT entity_id, unnest(identifiers) AS i FROM entities) x JOIN act USING (entity_id))"""
_CAND = f"c AS (SELECT record_id, type_key, {_SQ.format('name')} AS nm FROM extracted_entities), ci AS (SELECT DISTINCT record_id, type_key, i.field_key AS f, lower(trim(i.value)) AS v FROM (SELECT record_id, type_key, unnest(identifiers) AS i FROM extracted_entities) WHERE trim(i.value) <> '')"

ORACLE = {
    "evidence_units": f"WITH {_N}, {_E} SELECT evidence_id, note_id, unit_kind, unit_index, content_hash FROM ev",
    "notes_flat": f"WITH {_N} SELECT id AS note_id, x.title AS title, x.oname AS owner_name, x.oemail AS owner_email, x.cal AS calendar_event_id, epoch_us(x.u) AS updated_us, array_to_string(list_transform(x.f, lambda f: f.id), ',') AS folder_ids FROM n0",
    "attendees": f"WITH {_N}, a AS (SELECT id, unnest(range(len(x.a))) AS place, unnest(x.a) AS a FROM n0) SELECT id AS note_id, place, a.name AS name, a.email AS email FROM a WHERE trim(a.name) <> ''",
    "first_summary": f"WITH {_N}, {_E} SELECT note_id, arg_min(content, (unit_index, evidence_id)) AS summary FROM ev WHERE unit_kind = 'summary' GROUP BY 1",
    "evidence_refreshed": f"""WITH {_N}, {_E}, o0 AS (SELECT DISTINCT id AS note_id, {_STRIP.format('summary_text')} AS content FROM notes), o AS (SELECT *, sha256(content) AS h FROM o0 WHERE content <> ''),
o2 AS (SELECT 'ev_' || substr(sha256(note_id || ':summary:0:' || h), 1, 32) AS evidence_id, note_id FROM o) SELECT evidence_id, note_id, evidence_id IN (SELECT evidence_id FROM ev WHERE unit_kind = 'summary') AS is_active FROM o2""",
    "evidence_context": f"""WITH {_N}, {_E}, wt AS (SELECT id AS note_id, {_WORDS.format("concat_ws(' ', x.title, " + _S + ")")} AS w FROM n0),
p AS (SELECT ev.*, CASE WHEN unit_kind = 'summary' THEN 0 ELSE 1 END AS k, CASE WHEN unit_kind = 'summary' THEN 0 ELSE len(list_intersect({_WORDS.format('content')}, w)) END AS shared FROM ev JOIN wt USING (note_id)),
b AS (SELECT *, row_number() OVER o AS place, coalesce(sum(length(content)) OVER (PARTITION BY note_id ORDER BY k, shared DESC, unit_index, evidence_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM p WINDOW o AS (PARTITION BY note_id ORDER BY k, shared DESC, unit_index, evidence_id))
SELECT note_id, place, evidence_id, CAST(least(length(content), 12000 - before) AS BIGINT) AS size FROM b WHERE before < 12000""",
    "ontology_rows": f"""WITH {_FIELDS}, {_TYPES}, j AS (SELECT ty.type_key, fd.field_key, ty.type_key IN ('meeting', 'person') AS is_seed,
  len(list_intersect({_WORDS.format("concat_ws(' ', ty.type_key, ty.type_key, 'a ' || ty.type_key, coalesce(fd.field_key, ''), coalesce(fd.field_key, ''))")}, {_WORDS.format("'Company strategy: an organisation and its topic'")})) AS shared FROM ty LEFT JOIN fd USING (type_key))
SELECT type_key, field_key, is_seed, CAST(shared AS BIGINT) AS shared FROM j ORDER BY NOT is_seed, shared DESC, type_key, field_key NULLS FIRST LIMIT 48""",
    "ontology_relations": f"""WITH {_FIELDS}, {_TYPES}, j AS (SELECT ty.type_key, fd.field_key, ty.type_key IN ('meeting', 'person') AS is_seed,
  len(list_intersect({_WORDS.format("concat_ws(' ', ty.type_key, ty.type_key, 'a ' || ty.type_key, coalesce(fd.field_key, ''), coalesce(fd.field_key, ''))")}, {_WORDS.format("'Company strategy: an organisation and its topic'")})) AS shared FROM ty LEFT JOIN fd USING (type_key)),
c AS (SELECT type_key FROM j ORDER BY NOT is_seed, shared DESC, type_key, field_key NULLS FIRST LIMIT 6), r AS (SELECT 'of_' || type_key AS relation_key, 'person' AS s, type_key AS t FROM ty UNION ALL SELECT 'like_' || type_key, type_key, type_key FROM ty)
SELECT relation_key, s AS source_type_key, t AS target_type_key FROM r WHERE s IN (SELECT * FROM c) AND t IN (SELECT * FROM c) ORDER BY 1 LIMIT 6""",
    "type_equivalence": f"WITH {_TYPES} SELECT type_key, CASE WHEN type_key IN ('company', 'organization', 'organisation', 'business') THEN (SELECT arg_min(t.type_key, CASE t.type_key WHEN 'company' THEN 0 WHEN 'organization' THEN 1 WHEN 'organisation' THEN 2 ELSE 3 END) FROM ty t WHERE t.type_key IN ('company', 'organization', 'organisation', 'business')) WHEN type_key IN ('project', 'initiative') THEN 'project' WHEN type_key IN ('topic', 'subject') THEN 'topic' ELSE type_key END AS canonical FROM ty",
    "missing_evidence": "WITH c AS (SELECT DISTINCT note_id, unnest(evidence_ids) AS evidence_id FROM extracted_entities) SELECT note_id, string_agg(evidence_id, ',' ORDER BY evidence_id) AS missing FROM c WHERE NOT EXISTS (SELECT 1 FROM citations k WHERE k.note_id = c.note_id AND k.evidence_id = c.evidence_id) GROUP BY 1",
    "undeclared_fields": "WITH u AS (SELECT DISTINCT type_key, unnest(list_transform(identifiers, lambda i: i.field_key)) AS field_key FROM extracted_entities) SELECT type_key, field_key FROM u WHERE (type_key, field_key) NOT IN (('meeting', 'note_id'), ('person', 'email'))",
    "wrong_endpoints": """WITH f AS (SELECT note_id, min(record_id) AS r, arg_min(type_key, record_id) AS t FROM extracted_entities GROUP BY 1)
SELECT 'x:' || record_id AS source, 'attended' AS relation_key, note_id AS target FROM extracted_entities WHERE type_key <> 'person'
UNION ALL SELECT 'x:' || r, 'employs', 'x:' || record_id FROM extracted_entities JOIN f USING (note_id) WHERE NOT (t = 'company' AND type_key = 'person')
UNION ALL SELECT 'x:' || record_id, 'knows', 'x:' || r FROM extracted_entities JOIN f USING (note_id) WHERE type_key = 'person'""",
    "identifier_matches": """WITH k AS (SELECT entity_id, type_key, unnest(identifiers) AS i FROM entities WHERE status = 'active'), a AS (SELECT record_id, type_key, unnest(identifiers) AS i FROM extracted_entities),
h AS (SELECT a.record_id, count(DISTINCT k.entity_id) AS n, min(k.entity_id) AS m FROM a JOIN k ON k.type_key = a.type_key AND k.i.field_key = a.i.field_key AND lower(trim(k.i.raw_value)) = lower(trim(a.i.value)) GROUP BY 1)
SELECT record_id, n, CASE WHEN n = 1 THEN m END AS entity_id FROM h""",
    "name_matches": f"""WITH n AS (SELECT type_key, {_SQ.format('canonical_name')} AS name, min(entity_id) AS id FROM entities WHERE status = 'active' GROUP BY 1, 2 HAVING count(*) = 1),
a0 AS (SELECT type_key, unnest(aliases) AS a, entity_id FROM entities WHERE status = 'active'), a AS (SELECT type_key, {_SQ.format('a')} AS name, min(entity_id) AS id FROM a0 GROUP BY 1, 2 HAVING count(DISTINCT entity_id) = 1),
x AS (SELECT record_id, type_key, {_SQ.format('name')} AS name FROM extracted_entities)
SELECT record_id, coalesce(n.id, a.id) AS entity_id, CASE WHEN n.id IS NOT NULL THEN 'exact_name' WHEN a.id IS NOT NULL THEN 'exact_alias' ELSE 'created' END AS match_source FROM x LEFT JOIN n USING (type_key, name) LEFT JOIN a USING (type_key, name)""",
    "resolved": f"""WITH RECURSIVE {_STORE}, {_CAND},
sn AS (SELECT type_key, {_SQ.format('canonical_name')} AS nm, count(*) AS n, min(entity_id) AS id FROM act GROUP BY 1, 2), sa AS (SELECT type_key, {_SQ.format('a')} AS nm, count(DISTINCT entity_id) AS n, min(entity_id) AS id FROM (SELECT type_key, entity_id, unnest(aliases) AS a FROM entities SEMI JOIN act USING (entity_id)) GROUP BY 1, 2),
h AS (SELECT c.record_id, count(DISTINCT si.entity_id) AS n, min(si.entity_id) AS id FROM ci c JOIN si ON si.type_key = c.type_key AND si.f = c.f AND si.v = c.v GROUP BY 1),
d AS (SELECT c.record_id, c.type_key, c.nm, CASE WHEN h.n > 1 THEN 'conflict' WHEN h.n = 1 THEN 'exact_identifier' WHEN sn.n = 1 THEN 'exact_name' WHEN sn.n IS NULL AND sa.n = 1 THEN 'exact_alias' END AS src,
   CASE WHEN h.n > 1 THEN NULL WHEN h.n = 1 THEN h.id WHEN sn.n = 1 THEN sn.id WHEN sn.n IS NULL AND sa.n = 1 THEN sa.id END AS eid, coalesce(sn.n, sa.n, 0) > 1 AS amb
   FROM c LEFT JOIN h USING (record_id) LEFT JOIN sn ON sn.type_key = c.type_key AND sn.nm = c.nm LEFT JOIN sa ON sa.type_key = c.type_key AND sa.nm = c.nm),
k AS (SELECT record_id AS no, type_key, f || '=' || v AS key, true AS is_id FROM ci UNION ALL SELECT record_id, type_key, nm, false FROM c),
p AS (SELECT a.no, arg_min(b.no, (NOT a.is_id, b.no)) AS up, bool_or(a.is_id) AS by_id FROM k a JOIN d ON d.record_id = a.no AND d.src IS NULL AND (a.is_id OR NOT d.amb) JOIN k b ON b.type_key = a.type_key AND b.key = a.key AND b.is_id = a.is_id AND b.no < a.no JOIN d e ON e.record_id = b.no AND coalesce(e.src, '') <> 'conflict' GROUP BY 1),
r AS (SELECT no, up AS root, by_id FROM p UNION ALL SELECT r.no, p.up, r.by_id FROM r JOIN p ON p.no = r.root)
SELECT record_id, eid AS entity_id, src AS match_source FROM d WHERE src IS NOT NULL
UNION ALL SELECT r.no, d.eid, CASE WHEN r.by_id THEN 'exact_identifier' ELSE 'exact_alias' END FROM r JOIN d ON d.record_id = r.root WHERE d.src IS NOT NULL""",
    "resolved_new": f"""WITH RECURSIVE {_CAND},
k AS (SELECT record_id AS no, type_key, f || '=' || v AS key, true AS is_id FROM ci UNION ALL SELECT record_id, type_key, nm, false FROM c),
p AS (SELECT a.no, arg_min(b.no, (NOT a.is_id, b.no)) AS up FROM k a JOIN k b ON b.type_key = a.type_key AND b.key = a.key AND b.is_id = a.is_id AND b.no < a.no GROUP BY 1),
r AS (SELECT no, up AS root FROM p UNION ALL SELECT r.no, p.up FROM r JOIN p ON p.no = r.root)
SELECT record_id, coalesce((SELECT min(root) FROM r WHERE r.no = c.record_id), record_id) AS first_id FROM c""",
    "alias_lists": "WITH a AS (SELECT DISTINCT entity_id, unnest(aliases) AS alias FROM entities) SELECT entity_id, string_agg(alias, ' ' ORDER BY alias) AS aliases FROM a GROUP BY 1",
    "aliases_inserted": f"WITH e0 AS (SELECT type_key, unnest(aliases) AS a FROM entities), e AS (SELECT DISTINCT type_key, {_SQ.format('a')} AS alias FROM e0), x AS (SELECT DISTINCT type_key, {_SQ.format('name')} AS alias FROM extracted_entities) SELECT type_key, alias, 'entities' AS origin FROM e UNION ALL SELECT type_key, alias, 'extracted' FROM x WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.type_key = x.type_key AND e.alias = x.alias)",
    "duplicate_keys": "WITH k AS (SELECT type_key || '_' || local_id AS key FROM extracted_entities) SELECT DISTINCT key, 'form' AS problem FROM k WHERE NOT regexp_matches(key, '^[a-z][a-z0-9_]*$') UNION SELECT key, 'repeated' FROM k GROUP BY 1 HAVING count(*) > 1",
    "queue_counts": f"WITH {_Q0} SELECT s AS state, (SELECT count(*) FROM q WHERE q.state = s) AS n FROM (SELECT unnest(['pending', 'processing', 'complete', 'failed']) AS s)",
    "ingestion_status": f"WITH {_Q0} SELECT (SELECT epoch_us(max(watermark)) FROM sync_state) AS watermark_us, count(*) FILTER (WHERE state = 'pending') AS pending, count(*) FILTER (WHERE state = 'processing') AS processing, count(*) FILTER (WHERE state = 'complete') AS complete, count(*) FILTER (WHERE state = 'failed') AS failed FROM q",
    "queue_claimable": f"WITH {_Q0} SELECT note_id, state, attempts FROM q WHERE state IN ('pending', 'failed') AND attempts < 5 ORDER BY updated_at, queued_at, note_id LIMIT 100",
    "queue_claimed": f"WITH {_Q0}, c AS (SELECT note_id, CASE WHEN state IN ('pending', 'failed') AND attempts < 5 THEN 'processing' ELSE state END AS state, CASE WHEN state IN ('pending', 'failed') AND attempts < 5 THEN attempts + 1 ELSE attempts END AS attempts FROM q) SELECT note_id, state, attempts FROM c",
    "queue_recovered": f"WITH {_Q0} SELECT note_id, CASE WHEN state = 'processing' THEN 'pending' ELSE state END AS state FROM q",
    "queue_reprocessed": f"WITH {_Q0}, l AS (SELECT id FROM note_feed GROUP BY 1 HAVING max(updated_at) >= TIMESTAMP '2026-07-15 09:00:00'), c AS (SELECT q.note_id, CASE WHEN l.id IS NULL THEN state ELSE 'pending' END AS state, CASE WHEN l.id IS NULL THEN attempts ELSE 0 END AS attempts, CASE WHEN l.id IS NULL THEN force_reprocess ELSE true END AS force_reprocess FROM q LEFT JOIN l ON l.id = q.note_id) SELECT note_id, state, attempts, force_reprocess FROM c",
    "queue_discovered": f"WITH {_Q0}, f AS (SELECT id AS note_id, max(updated_at) AS v FROM note_feed GROUP BY 1) SELECT coalesce(q.note_id, f.note_id) AS note_id, epoch_us(CASE WHEN q.note_id IS NULL OR q.remote_updated_at < f.v THEN f.v ELSE q.remote_updated_at END) AS version_us, CASE WHEN q.note_id IS NULL OR q.remote_updated_at < f.v THEN 'pending' ELSE q.state END AS state, CASE WHEN q.note_id IS NULL OR q.remote_updated_at < f.v THEN 0 ELSE q.attempts END AS attempts, CASE WHEN q.note_id IS NULL OR q.remote_updated_at < f.v THEN false ELSE q.force_reprocess END AS force_reprocess FROM q FULL JOIN f USING (note_id)",
    "feed_after_mark": "SELECT count(*) AS n, count(DISTINCT id) AS notes, epoch_us(max(updated_at)) AS mark_us FROM note_feed WHERE updated_at > (SELECT watermark FROM sync_state)",
    "notes_upserted": f"WITH {_N}, f AS (SELECT id, arg_max({{'t': title, 'c': created_at, 'u': updated_at}}, (updated_at, feed_seq)) AS y FROM note_feed GROUP BY 1) SELECT coalesce(n0.id, f.id) AS note_id, CASE WHEN f.id IS NULL THEN x.title ELSE y.t END AS title, epoch_us(CASE WHEN n0.id IS NULL THEN y.c ELSE x.c END) AS created_us, epoch_us(CASE WHEN f.id IS NULL THEN x.u ELSE y.u END) AS updated_us, x.w AS web_url FROM n0 FULL JOIN f ON f.id = n0.id",
    "notes_hidden": f"WITH {_N}, f AS (SELECT id, arg_max({{'t': title}}, (updated_at, feed_seq)) AS y FROM note_feed GROUP BY 1) SELECT n0.id AS note_id, CASE WHEN y.t IS NULL THEN 'hidden' ELSE 'active' END AS visibility FROM n0 LEFT JOIN f USING (id)",
    "facts_retired": "WITH f AS (SELECT id, max(updated_at) AS v FROM note_feed GROUP BY 1), q AS (SELECT note_id, max(remote_updated_at) AS w FROM processing_queue GROUP BY 1), s AS (SELECT f.id FROM f LEFT JOIN q ON q.note_id = f.id WHERE w IS NULL OR w < v) SELECT citation_no, note_id, note_id NOT IN (SELECT id FROM s) AS is_active FROM citations",
    "changed_notes": "WITH n AS (SELECT id, min(updated_at) AS u FROM notes GROUP BY 1), f AS (SELECT id, max(updated_at) AS v FROM note_feed GROUP BY 1) SELECT f.id AS note_id, CASE WHEN n.id IS NULL THEN 'unseen' ELSE 'newer' END AS change FROM f LEFT JOIN n USING (id) WHERE n.id IS NULL OR u < v",
    "sync_report": "WITH p AS (SELECT id, updated_at, count(*) AS n FROM note_feed GROUP BY 1, 2) SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS versions, count(DISTINCT id) AS notes, count(*) FILTER (WHERE n > 1) AS redelivered FROM p",
    "identities": f"""WITH h AS (SELECT *, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('entity:' || entity_id)) AS h FROM entities)
SELECT record_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', CAST(('0x' || substr(h, 17, 1))::INT % 4 + 1 AS INT), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id5,
sha256(canonical_name) AS digest, 'entity:' || type_key || ':' || {_SQ.format('canonical_name')} AS group_key, CASE WHEN length(canonical_name) > 28 THEN substr(canonical_name, 1, 26) || '…' ELSE canonical_name END AS label,
CAST(ceil(length(canonical_name) / 4) AS BIGINT) AS tokens, regexp_matches(type_key, '^[a-z][a-z0-9_]*$') AS is_key, strftime(created_at, '%Y-%m-%dT%H:%M:%S.%fZ') AS created FROM h""",
    "graph_layout": """WITH h AS (SELECT n_nationkey, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(n_name, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda a, c: ((a * 31 + c + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648) AS h FROM nation)
SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CAST(abs(h) % 8 AS BIGINT) AS colour, round((55 + 265 * sqrt((n_nationkey + 1) / 25)) * cos(n_nationkey * 2.399963), 6) AS x, round((55 + 265 * sqrt((n_nationkey + 1) / 25)) * sin(n_nationkey * 2.399963), 6) AS y FROM h""",
    "filtered_nodes": "SELECT record_id, canonical_name, type_key FROM entities WHERE contains(lower(canonical_name || ' ' || type_key), 'son')",
    "type_list": f"WITH {_FIELDS}, {_TYPES} SELECT ty.type_key, (SELECT count(*) FROM entities e WHERE e.type_key = ty.type_key) AS entities, (SELECT count(*) FROM fd WHERE fd.type_key = ty.type_key) AS fields FROM ty",
}
