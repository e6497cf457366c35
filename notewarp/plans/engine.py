"""The engine: a store of versioned tables, and what a caller does with it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewarp.operators import ontology as O
from notewarp.operators.context import evidence_context, ontology_context
from notewarp.operators.extraction import MAX_INPUT_TOKENS, RUNS, USAGE, apply, contract_errors, extract, parse, within_budget
from notewarp.operators.graph import citations, entity_detail, overview, panel, traverse
from notewarp.operators.materialize import current_notes, flat_notes, nested_transcript_units, refresh_evidence, summary_units
from notewarp.operators.merge import hide_missing, upsert, with_defaults
from notewarp.operators.search import TextIndex
from notewarp.operators.snapshot import Snapshot, discover_steps
from notewarp.functions.text import query_phrases
from notewarp.plans.search import search
from notewarp.session import cut, release
from notewarp.settings import PROMPT_VERSION
from notewarp.streaming import queue as Q
from notewarp.streaming.discovery import SYNC_STATE

NOTES = "note_id string, title string, owner_name string, owner_email string, web_url string, calendar_event_id string, scheduled_start timestamp, scheduled_end timestamp, created_at timestamp, updated_at timestamp, content_hash string, folder_ids array<string>, visibility string, processed_hash string"
EVIDENCE = "evidence_id string, note_id string, unit_kind string, unit_index long, content string, content_hash string, speaker_name string, started_at timestamp, ended_at timestamp, is_active boolean"
ENTITIES = "entity_id string, canonical_name string, type_key string, status string, scope_note_id string, created_at timestamp"
ENTITY_ALIASES = "entity_id string, normalized_alias string, alias string, source_evidence_id string"
IDENTIFIERS = "entity_id string, field_key string, normalized_value string, raw_value string, source_evidence_id string"
PROPERTIES = "property_id string, entity_id string, field_key string, value_json string, normalized_value string, confidence double, evidence_id string, is_active boolean, created_at timestamp"
EDGES = "edge_id string, source string, relation string, target string, evidence_id string, confidence double, is_active boolean"
REVISIONS = "revision int, reason string, source_note_id string"
FIRST = {"notes": NOTES, "evidence": EVIDENCE, "entities": ENTITIES, "entity_aliases": ENTITY_ALIASES, "entity_properties": PROPERTIES, "edges": EDGES, "queue": Q.QUEUE, "sync_state": SYNC_STATE}
SOURCE = "notes"
#: Text that each index covers.
INDEXED = {"note": ("note_id", ["title", "summary"]), "evidence": ("evidence_id", ["content"]), "entity": ("entity_id", ["canonical_name", "aliases"])}
GRAPH = ("entities", "entity_aliases", "entity_identifiers", "entity_properties", "edges", "extraction_runs", "ontology_revisions", "entity_types", "field_definitions", "relation_types", "entity_type_aliases")


def _empty(spark: SparkSession, schemas: dict[str, str]) -> dict[str, DataFrame]:
    return {name: spark.createDataFrame([], schema) for name, schema in schemas.items()}


def schema_steps(spark: SparkSession) -> list[Callable]:
    """The steps from an empty store to the present schema; each maps the tables that are there to changed or new ones."""

    def revisions(_):
        first = spark.createDataFrame([(1, "seed", None)], REVISIONS)
        return {"ontology_revisions": first}

    return discover_steps({
        "001_tables": lambda _: {**_empty(spark, FIRST), **O.seed(spark)},
        "002_revisions": revisions,
        "003_identifiers": lambda _: _empty(spark, {"entity_identifiers": IDENTIFIERS, "extraction_runs": RUNS}),
        # columns that older stores lack
        "004_columns": lambda t: {"entities": with_defaults(t["entities"], {"scope_note_id": F.lit(None).cast("string"), "created_at": F.lit(None).cast("timestamp")}), "entity_properties": with_defaults(t["entity_properties"], {"created_at": F.lit(None).cast("timestamp")})},
    })


class Engine:
    """A knowledge graph over notes below `path`; every change is one version of all tables it touches."""

    def __init__(self, spark: SparkSession, path: str, *, buckets: int = 64) -> None:
        self.spark, self.store, self.buckets = spark, Snapshot(spark, path), buckets

    def close(self) -> None:
        """Delete what this process has left in the shared folder; results not yet read are lost."""
        release(self.spark)

    def init(self) -> int:
        """Bring the store to the present schema: tables and the seed of the ontology, and whatever older stores lack."""
        self.store.migrate(schema_steps(self.spark))
        return self.store.manifest()["version"]

    def table(self, name: str) -> DataFrame:
        return self.store.table(name)

    def index(self, kind: str) -> TextIndex:
        return TextIndex(self.spark, f"{self.store.path}/index-{kind}")

    def corpus(self, kind: str) -> DataFrame:
        """What an index covers: materialised visible notes, their active evidence, active entities with all names and active values."""
        if kind == "entity":
            names = self.table("entity_aliases").groupBy("entity_id").agg(F.array_join(F.array_sort(F.collect_set("alias")), " ").alias("names"))
            facts = self.table("entity_properties").filter("is_active").groupBy("entity_id").agg(F.array_join(F.array_sort(F.collect_list("value_json")), " ").alias("facts"))
            entities = self.table("entities").filter("status = 'active'").join(names, "entity_id", "left").join(facts, "entity_id", "left")
            return entities.select("entity_id", "type_key", "canonical_name", F.concat_ws(" ", "names", "facts").alias("aliases"))
        notes = self.table("notes").filter("visibility = 'active' and content_hash is not null")
        evidence = self.table("evidence").filter("is_active").join(notes.select("note_id", F.col("title").alias("note_title")), "note_id")
        if kind == "evidence":
            return evidence.select("evidence_id", "note_id", "note_title", "content")
        first = evidence.filter("unit_kind = 'summary'").groupBy("note_id").agg(F.min_by("content", F.struct("unit_index", "evidence_id")).alias("summary"))
        return notes.select("note_id", "title").join(first, "note_id", "left")

    def reindex(self) -> None:
        """Build all three indexes anew from the tables."""
        for kind, (key, columns) in INDEXED.items():
            self.index(kind).build(self.corpus(kind), key, columns, buckets=self.buckets)

    def _refresh(self, kind: str, ids: DataFrame) -> None:
        """Bring one index up to date for the given documents (id); those that are no more in the corpus leave it."""
        key, columns = INDEXED[kind]
        index = self.index(kind)
        if not index.exists():
            index.build(self.corpus(kind), key, columns, buckets=self.buckets)
            return
        ids = cut(ids.select(F.col(ids.columns[0]).alias(key)).distinct())
        docs = cut(self.corpus(kind).join(ids, key, "left_semi"))
        index.update(docs, key, gone=ids.join(docs, key, "left_anti"))

    def _refresh_notes(self, notes: DataFrame) -> None:
        notes = cut(notes.select("note_id").distinct())
        self._refresh("note", notes)
        self._refresh("evidence", self.table("evidence").join(notes, "note_id", "left_semi").select("evidence_id"))

    def sync(self, feed: DataFrame, *, reconcile: bool = False, folder_id: str | None = None, limit: int | None = None, error: str | None = None) -> dict[str, int]:
        """Discover notes newer than the mark, or with `reconcile` all of a full listing and hide what it lacks.

        Queue, notes and mark move in one version; a pass that failed (`error`) only records that. With `folder_id` only the notes of that
        folder are discovered, and a reconciliation hides all others.
        """
        base = self.store.manifest()["version"]
        state = Q.begin(self.table("sync_state"), SOURCE)
        if error is not None:
            self.store.commit({"sync_state": Q.advance(state, SOURCE, feed.limit(0), error=error)}, expected=base)
            return {"discovered": 0, "enqueued": 0, "hidden": 0}
        feed = feed.withColumn("updated_at", F.col("updated_at").cast("timestamp"))
        if folder_id is not None:
            feed = feed.filter(F.exists("folder_membership", lambda f: f["id"] == folder_id) if "folder_membership" in feed.columns else F.col("folder_id") == folder_id)
        new = cut(feed if reconcile else Q.after_mark(feed, state, SOURCE))
        before = self.table("queue")
        queue = cut(Q.discover(before, new.select("id", "updated_at")))
        changed = queue.join(before.select("note_id", F.col("remote_updated_at").alias("known")), "note_id", "left").filter("known is null or known <> remote_updated_at").count()
        shown = {"title": F.col("title") if "title" in new.columns else F.lit(None).cast("string"), "updated_at": F.col("updated_at"), "visibility": F.lit("active")}
        if "owner" in new.columns:
            shown |= {"owner_name": F.col("owner.name"), "owner_email": F.col("owner.email")}
        if "created_at" in new.columns:
            shown["created_at"] = F.col("created_at").cast("timestamp")
        summaries = new.filter("id is not null").select(F.col("id").alias("note_id"), *[c.alias(k) for k, c in shown.items()])
        notes = upsert(self.table("notes"), summaries, ["note_id"], keep=["created_at"], order=["updated_at"])
        gone = None
        if reconcile:
            seen = cut(notes)
            notes = hide_missing(seen, feed.select(F.col("id").alias("note_id")))
            gone = cut(notes.filter("visibility = 'hidden'").select("note_id").join(seen.filter("visibility = 'active'").select("note_id"), "note_id", "left_semi"))
        self.store.commit({"queue": queue, "sync_state": Q.advance(state, SOURCE, new), "notes": notes.select(self.table("notes").columns)}, expected=base)
        hidden = gone.count() if gone is not None else 0
        if hidden:
            self._refresh_notes(gone)
        return {"discovered": new.count(), "enqueued": changed, "hidden": hidden}

    def process(self, details: DataFrame, extractor: Callable, *, limit: int | None = None, max_attempts: int = Q.MAX_ATTEMPTS, **run) -> dict[str, int]:
        """Drain the queue: rounds of claim, materialise, extract and apply until nothing may be claimed or `limit` jobs are done.

        A job that fails is tried again in the next round while it has attempts left. Counted are notes, by how they ended.
        """
        self.store.commit({"queue": Q.recover(self.table("queue"))})
        left, outcomes = limit, None
        while left is None or left > 0:
            got = self._round(details, extractor, limit=left, max_attempts=max_attempts, **run)
            if got is None:
                break
            outcomes = got if outcomes is None else cut(outcomes.join(got.select("note_id"), "note_id", "left_anti").unionByName(got))
            left = left if left is None else left - got.count()
        counted = {r["outcome"]: r["n"] for r in outcomes.groupBy("outcome").agg(F.count("*").alias("n")).collect()} if outcomes is not None else {}
        return {k: counted.get(k, 0) for k in ("completed", "skipped", "failed")}

    def _round(self, details: DataFrame, extractor: Callable, *, limit: int | None, max_attempts: int, prompt_version: str = PROMPT_VERSION, model_name: str = "", max_input_tokens: int = MAX_INPUT_TOKENS) -> DataFrame | None:
        """(note_id, outcome) of the jobs that were claimed; None where there was none. Errors stay with their note.

        Evidence is materialised in its own version before extraction, so it survives an extraction that fails.
        """
        queue, claimed = Q.claim(self.table("queue"), max_attempts=max_attempts, limit=limit)
        claimed = cut(claimed)
        if claimed.isEmpty():
            return None
        self.store.commit({"queue": queue})
        current = current_notes(details).join(claimed.select(F.col("note_id").alias("id")), "id", "left_semi")
        flat = cut(flat_notes(current).withColumn("created_at", F.col("created_at").cast("timestamp")).withColumn("updated_at", F.col("updated_at").cast("timestamp")))
        units = summary_units(current)
        if "transcript" in current.columns:
            units = units.unionByName(nested_transcript_units(current), allowMissingColumns=True)
        evidence = refresh_evidence(self.table("evidence"), units, flat)
        notes = upsert(self.table("notes"), flat, ["note_id"], keep=["created_at", "processed_hash"])
        self.store.commit({"notes": notes, "evidence": evidence})
        notes, evidence = self.table("notes"), self.table("evidence")
        skipped = cut(Q.skippable(claimed, notes).select("note_id"))
        wanted = claimed.select("note_id").join(skipped, "note_id", "left_anti").join(flat.select("note_id"), "note_id", "left_semi")
        prompts = cut(self._prompts(wanted, notes, evidence))
        answered = cut(extract(within_budget(prompts, tokens=max_input_tokens), extractor))
        read = cut(parse(answered.filter("error is null").select("note_id", "response")))
        failed = answered.filter("error is not null").select("note_id", "error").unionByName(contract_errors(read))
        failed = failed.unionByName(prompts.join(answered.select("note_id"), "note_id", "left_anti").select("note_id", F.lit("over the budget").alias("error")))
        failed = cut(failed.unionByName(claimed.join(flat.select("note_id"), "note_id", "left_anti").select("note_id", F.lit("no such note").alias("error"))))
        good = read.join(failed.select("note_id"), "note_id", "left_anti")
        runs = answered.select("note_id", *USAGE, F.lit(prompt_version).alias("prompt_version"), F.lit(model_name).alias("model_name"))
        old = {t: self.table(t) for t in GRAPH}
        after = apply(old, good, evidence, notes, runs=runs)
        failed = cut(failed.unionByName(after.rejected))
        outcome = claimed.select("note_id").join(failed, "note_id", "left")
        done = good.join(failed, "note_id", "left_anti").select("note_id").withColumn("__done", F.lit(True))
        marked = notes.join(done, "note_id", "left").withColumn("processed_hash", F.when(F.col("__done"), F.col("content_hash")).otherwise(F.col("processed_hash"))).drop("__done")
        stale = old["entity_properties"].filter("is_active").join(evidence.join(done, "note_id", "left_semi").select("evidence_id"), "evidence_id", "left_semi").select("entity_id")
        touched = cut(after.entity_ids.select(F.explode("entity_ids").alias("entity_id")).unionByName(stale).distinct())
        result = cut(claimed.select("note_id").join(failed, "note_id", "left").join(skipped.withColumn("__s", F.lit(True)), "note_id", "left").select("note_id", F.when(F.col("error").isNotNull(), "failed").when(F.col("__s"), "skipped").otherwise("completed").alias("outcome")))
        self.store.commit({**after.tables, "notes": marked, "queue": Q.settle(self.table("queue"), outcome)})
        self._refresh_notes(flat)
        self._refresh("entity", touched)
        return result

    def _prompts(self, wanted: DataFrame, notes: DataFrame, evidence: DataFrame) -> DataFrame:
        """(note_id, title, evidence_json, ontology_json): the ontology is ranked by the words it shares with the batch's titles."""
        titled = cut(wanted.join(notes.select("note_id", F.coalesce(F.nullif(F.col("title"), F.lit("")), F.lit("Untitled meeting")).alias("title")), "note_id"))
        shown = evidence_context(evidence.join(wanted, "note_id", "left_semi"), notes)
        per_note = shown.groupBy("note_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("place", "evidence_id", "content"))), lambda e: F.struct(e["evidence_id"].alias("evidence_id"), e["content"].alias("content")))).alias("evidence_json"))
        # words of the titles, the commonest ones; a bounded list
        words = titled.select(F.explode(F.split(F.lower("title"), r"\W+")).alias("w")).filter("length(w) > 2").groupBy("w").count().orderBy(F.desc("count"), "w").limit(200)
        context = " ".join(r.w for r in words.collect())
        types, relations = ontology_context(self.table("entity_types"), self.table("field_definitions"), self.table("relation_types"), context)
        types = types.agg(F.collect_list(F.struct("type_key", "display_name", "description", "identity_scope", "field_key", "data_type", "is_identifier")).alias("entity_types"))
        relations = relations.agg(F.collect_list(F.struct("relation_key", "display_name", "source_type_key", "target_type_key")).alias("relation_types"))
        # at most ONTOLOGY_ROWS rows each
        ontology = F.lit(types.select(F.to_json(F.struct("entity_types"))).first()[0][:-1] + "," + relations.select(F.to_json(F.struct("relation_types"))).first()[0][1:])
        return titled.join(per_note, "note_id", "left").select("note_id", "title", F.coalesce("evidence_json", F.lit("[]")).alias("evidence_json"), ontology.alias("ontology_json"))

    def reprocess(self, note_ids: list[str] | None = None) -> None:
        """Queue notes again, or all; an unknown id is an error."""
        queue = self.table("queue")
        chosen = None
        if note_ids is not None:
            chosen = self.spark.createDataFrame([(n,) for n in note_ids], "note_id string")
            if not chosen.join(queue, "note_id", "left_anti").isEmpty():
                raise KeyError("unknown note")
        self.store.commit({"queue": Q.reprocess(queue, chosen)})

    def propose(self, proposed: dict[str, DataFrame], *, reason: str = "proposal", source_note_id: str | None = None) -> int:
        """Evolve the ontology by a proposal; returns the revision, the present one where nothing is proposed."""
        names = ("entity_types", "field_definitions", "relation_types", "entity_type_aliases")
        revisions = self.table("ontology_revisions")
        revision = O.next_revision(revisions).first()["revision"]
        if all(p.isEmpty() for p in proposed.values()):
            return revision - 1
        new = self.spark.createDataFrame([(revision, reason, source_note_id)], REVISIONS)
        self.store.commit({**O.evolve({n: self.table(n) for n in names}, proposed, revision), "ontology_revisions": revisions.unionByName(new)})
        return revision

    def status(self) -> dict:
        counts = {r["state"]: r["n"] for r in Q.counts(self.table("queue")).collect()}
        mark = self.table("sync_state").filter(F.col("source_key") == SOURCE).select("watermark", "last_error").first()
        return {"watermark": mark and mark["watermark"], "last_error": mark and mark["last_error"], **counts}

    def search(self, query: str, *, type_keys: tuple[str, ...] = (), limit: int = 20) -> DataFrame:
        """Unified search by the stored indexes: of the corpora only the rows that are shown are read."""
        ranked = {}
        if query_phrases(query) is not None:
            for kind, (key, columns) in INDEXED.items():
                if not self.index(kind).exists():
                    self.index(kind).build(self.corpus(kind), key, columns, buckets=self.buckets)
                ranked[kind] = self.index(kind).search(query, limit=None).withColumnRenamed("doc", key)
        return search(self.corpus("note"), self.corpus("evidence"), self.corpus("entity"), query, type_keys=type_keys, limit=limit, ranked=ranked)

    def entity(self, entity_id: str) -> DataFrame:
        return entity_detail(self.table("entities"), self.table("entity_aliases"), self.table("entity_identifiers"), self.table("entity_properties"), self.table("evidence"), self.table("notes"), entity_id)

    def record(self, entity_id: str) -> DataFrame:
        """The stored row of an entity, whatever its status."""
        return self.table("entities").filter(F.col("entity_id") == entity_id)

    def panel(self, entity_id: str) -> DataFrame:
        return panel(self.table("edges"), self.table("entities"), entity_id)

    def evidence(self, evidence_id: str) -> DataFrame:
        return citations(self.table("evidence"), self.table("notes")).filter(F.col("evidence_id") == evidence_id)

    def traverse(self, entity_id: str, *, depth: int = 2, limit: int = 100) -> DataFrame:
        return traverse(self.table("edges"), self.table("entities"), entity_id, depth=depth, limit=limit)

    def overview(self) -> tuple[DataFrame, DataFrame]:
        return overview(self.table("entities").withColumnRenamed("created_at", "updated_at"), self.table("edges"))

    def entity_types(self) -> DataFrame:
        return self.table("entity_types").orderBy("type_key")
