"""Structured extractions: the contract, its checks, and applying a batch to the graph as one version."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from notewarp.functions.scalar import MEETING_PREFIX, edge_id, estimated_tokens, is_key, property_id, uuid5
from notewarp.operators import ontology as O
from notewarp.operators.merge import flag_where, insert_or_ignore, upsert
from notewarp.operators.resolve import identifier_value, resolve, scope_errors
from notewarp.session import cut
from notewarp.sources.paged import unknown_keys

#: What an extractor returns for a note. Unknown keys at any depth are an error (`unknown_keys`), not silently dropped.
CONTRACT = (
    "ontology struct<entity_types:array<struct<key:string,display_name:string,description:string,identity_scope:string,"
    "fields:array<struct<key:string,display_name:string,description:string,data_type:string,is_identifier:boolean>>>>,"
    "relation_types:array<struct<key:string,display_name:string,description:string,source_type_key:string,target_type_key:string,is_directed:boolean>>>,"
    "entities array<struct<local_id:string,type_key:string,name:string,identifiers:array<struct<field_key:string,value:string>>,evidence_ids:array<string>,"
    "properties:array<struct<field_key:string,value:variant,evidence_ids:array<string>,confidence:double>>>>,"
    "relations array<struct<source_local_id:string,relation_key:string,target_local_id:string,evidence_ids:array<string>,confidence:double>>"
)
# Tokens of a prompt, estimated from its characters; kinds of values of a field; scopes of a type.
MAX_INPUT_TOKENS = 6500
DATA_TYPES = ["string", "text", "url", "email", "phone", "number", "boolean", "date", "datetime"]
SCOPES = ["global", "note"]
RUNS = "run_id string, note_id string, prompt_version string, model_name string, input_tokens long, output_tokens long, cached_input_tokens long, reasoning_tokens long, state string, revision int"
PROMPT = """Title of the meeting: {title}

<ontology>
{ontology}
</ontology>

<evidence>
{evidence}
</evidence>

Answer with one JSON object of the keys ontology, entities and relations; cite evidence by its evidence_id.
"""


def prompt(title: Column, evidence_json: Column, ontology_json: Column) -> Column:
    """What an extractor is asked, as one text."""
    before, mid, rest = PROMPT.partition("{title}")[0], *PROMPT.partition("{title}")[2].split("{ontology}")
    between, after = rest.split("{evidence}")
    return F.concat(F.lit(before), title, F.lit(mid), ontology_json, F.lit(between), evidence_json, F.lit(after))


def json_schema(schema: StructType | None = None) -> dict:
    """The contract as a JSON schema for providers that take one: every object is closed and all its keys are required."""

    def of(kind) -> dict:
        if isinstance(kind, StructType):
            return {"type": "object", "additionalProperties": False, "required": kind.fieldNames(), "properties": {f.name: of(f.dataType) for f in kind.fields}}
        if isinstance(kind, ArrayType):
            return {"type": "array", "items": of(kind.elementType)}
        return {"string": {"type": "string"}, "boolean": {"type": "boolean"}, "double": {"type": ["number", "null"]}, "variant": {"type": ["string", "number", "boolean"]}}[kind.simpleString()]

    return of(schema or StructType.fromDDL(CONTRACT))


def parse(responses: DataFrame) -> DataFrame:
    """(note_id, x, error): `response` read by the contract; malformed JSON and unknown keys are errors of their row, not of the job."""
    wanted = StructType.fromDDL(CONTRACT)
    fault = unknown_keys(F.col("response"), wanted)
    read = responses.withColumn("x", F.from_json("response", CONTRACT, {"mode": "PERMISSIVE"})).withColumn("fault", fault)
    return read.select("note_id", "x", F.when(F.col("fault").isNull(), "malformed").when(F.col("fault"), "unknown_keys").alias("error"))


def contract_errors(parsed: DataFrame) -> DataFrame:
    """(note_id, error) of extractions that break a rule: keys well formed and unique, local ids unique, relation ends known, known data
    types and scopes, confidences in [0, 1], names, values and evidence not empty."""
    ids = F.transform("x.entities", lambda e: e["local_id"])
    different = lambda keys: F.size(keys) != F.size(F.array_distinct(keys))
    types, relations = F.coalesce("x.ontology.entity_types", F.array().cast(_kind("ontology", "entity_types"))), F.coalesce("x.ontology.relation_types", F.array().cast(_kind("ontology", "relation_types")))
    keys = F.concat(F.transform(types, lambda t: t["key"]), F.transform(relations, lambda r: r["key"]))
    fields = F.flatten(F.transform(types, lambda t: F.coalesce(t["fields"], F.array().cast(_kind("ontology", "entity_types").elementType["fields"].dataType))))
    formed = F.forall(F.concat(keys, F.transform(fields, lambda f: f["key"])), lambda k: F.coalesce(is_key(k), F.lit(False)))
    twice_defined = different(F.transform(types, lambda t: t["key"])) | different(F.transform(relations, lambda r: r["key"])) | F.exists(types, lambda t: different(F.transform(t["fields"], lambda f: f["key"])))
    kinds = F.forall(fields, lambda f: f["data_type"].isin(*DATA_TYPES)) & F.forall(types, lambda t: t["identity_scope"].isin(*SCOPES))
    twice = different(ids)
    dangling = F.exists("x.relations", lambda r: ~F.array_contains(ids, r["source_local_id"]) | ~F.array_contains(ids, r["target_local_id"]))
    unsure = F.exists("x.relations", lambda r: ~r["confidence"].between(0, 1)) | F.exists("x.entities", lambda e: F.exists(e["properties"], lambda p: ~p["confidence"].between(0, 1)))
    bare = F.exists("x.entities", lambda e: (F.trim(e["name"]) == "") | (F.size(e["evidence_ids"]) < 1) | F.exists(e["properties"], lambda p: (F.size(p["evidence_ids"]) < 1) | p["value"].isNull())) | F.exists("x.relations", lambda r: F.size(r["evidence_ids"]) < 1)
    error = (
        F.when(F.col("error").isNotNull(), F.col("error")).when(~formed, "key").when(twice_defined, "repeated_key").when(~kinds, "kind").when(twice, "repeated_local_id")
        .when(dangling, "unknown_endpoint").when(unsure, "confidence").when(bare, "empty")
    )
    return parsed.select("note_id", error.alias("error")).filter("error is not null")


def _kind(*path: str):
    kind = StructType.fromDDL(CONTRACT)
    for name in path:
        kind = kind[name].dataType
    return kind


def within_budget(prompts: DataFrame, *, tokens: int = MAX_INPUT_TOKENS) -> DataFrame:
    """Prompts (note_id, title, evidence_json, ontology_json) whose estimated size fits, with `estimate`."""
    return prompts.withColumn("estimate", estimated_tokens(prompt(F.col("title"), F.col("evidence_json"), F.col("ontology_json")))).filter(F.col("estimate") <= tokens)


USAGE = ["input_tokens", "output_tokens", "cached_input_tokens", "reasoning_tokens"]


def extract(prompts: DataFrame, extractor: Callable[[str, str, str], str | tuple[str, dict]]) -> DataFrame:
    """(note_id, response, error, and the counts of USAGE): `extractor(title, evidence_json, ontology_json)` per row; its errors stay with the row.

    An extractor returns the response, or the response and a dict of token counts; counts that it doesn't give are 0.
    """
    import pandas as pd

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                try:
                    got = extractor(r.title, r.evidence_json, r.ontology_json)
                    response, usage = got if isinstance(got, tuple) else (got, {})
                    out.append((r.note_id, response, None, *[int(usage.get(k) or 0) for k in USAGE]))
                except Exception as error:  # noqa: BLE001
                    out.append((r.note_id, None, f"{type(error).__name__}: {error}", *[0] * len(USAGE)))
            yield pd.DataFrame(out, columns=["note_id", "response", "error", *USAGE])

    return prompts.select("note_id", "title", "evidence_json", "ontology_json").mapInPandas(run, "note_id string, response string, error string, " + ", ".join(f"{k} long" for k in USAGE))


def value_text(value: Column) -> Column:
    """A property's value as text: numbers are floating point, truth values are True and False in lower case."""
    number = F.schema_of_variant(value).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)")
    return F.when(number, F.try_variant_get(value, "$", "double").cast("string")).otherwise(F.try_variant_get(value, "$", "string"))


def value_json(value: Column) -> Column:
    """A property's value as JSON; `3` is `3.0`."""
    is_text = F.schema_of_variant(value) == "STRING"
    return F.when(is_text, F.to_json(value)).otherwise(value_text(value))


@dataclass
class Applied:
    """What a batch makes of the graph: changed tables, (note_id, error) of what was left out, (note_id, entity_ids) in order."""

    tables: dict[str, DataFrame]
    rejected: DataFrame
    entity_ids: DataFrame


ONTOLOGY = ("entity_types", "field_definitions", "relation_types", "entity_type_aliases")


def proposals(good: DataFrame) -> dict[str, DataFrame]:
    """The ontology additions of a batch; of a key that several notes propose the note with the greatest id counts."""
    types = good.select("note_id", F.explode("x.ontology.entity_types").alias("t"))
    last = lambda rows, keys: rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in (*keys, "note_id")]), "note_id").alias("p")).select(*keys, "p.*")
    fields = types.select("note_id", F.col("t.key").alias("type_key"), F.explode("t.fields").alias("f")).select("note_id", "type_key", F.col("f.key").alias("field_key"), "f.display_name", "f.description", "f.data_type", "f.is_identifier")
    relations = good.select("note_id", F.explode("x.ontology.relation_types").alias("r")).select("note_id", F.col("r.key").alias("relation_key"), "r.display_name", "r.description", "r.source_type_key", "r.target_type_key", "r.is_directed")
    return {
        "entity_types": last(types.select("note_id", F.col("t.key").alias("type_key"), "t.display_name", "t.description", "t.identity_scope"), ["type_key"]),
        "field_definitions": last(fields, ["type_key", "field_key"]),
        "relation_types": last(relations, ["relation_key"]),
    }


def apply(graph: dict[str, DataFrame], parsed: DataFrame, evidence: DataFrame, notes: DataFrame, *, runs: DataFrame | None = None, meeting_prefix: str = MEETING_PREFIX) -> Applied:
    """The graph after a batch of extractions (note_id, x). Write `tables` with one `Snapshot.commit`.

    An extraction is left out as a whole, with its error, if it cites evidence that its note hasn't got, has an entity of an unknown type,
    an undeclared field, an identifier that isn't one, a relation between other types than declared, or identifiers of several entities.
    The others: proposals evolve the ontology by one revision, if there are any; the note's own meeting is an entity; meeting entities
    are the note's meeting; entities of a note's own type are of the note; facts that cite evidence of the batch's notes are retired, then
    properties and edges are merged by their name-based ids and become active again. `runs` is (note_id, counts of USAGE, prompt_version, model_name).
    """
    cited = parsed.select("note_id", F.explode(F.concat(
        F.flatten(F.transform("x.entities", lambda e: F.concat(F.coalesce(e["evidence_ids"], F.array().cast("array<string>")), F.flatten(F.transform(F.coalesce(e["properties"], F.array().cast(_kind("entities").elementType["properties"].dataType)), lambda p: p["evidence_ids"]))))),
        F.flatten(F.transform("x.relations", lambda r: r["evidence_ids"])),
    )).alias("evidence_id")).groupBy("note_id").agg(F.collect_set("evidence_id").alias("evidence_ids"))
    missing = O.missing_evidence(cited, evidence).select("note_id", F.concat(F.lit("no such evidence: "), F.array_join("missing", ", ")).alias("error"))
    good = cut(parsed.join(missing, "note_id", "left_anti").select("note_id", "x"))
    # ontology
    proposed = {k: cut(v) for k, v in proposals(good).items()}
    empty = all(p.isEmpty() for p in proposed.values())
    revisions = graph["ontology_revisions"]
    revision = O.next_revision(revisions).first()["revision"] - (1 if empty else 0)
    onto = {n: graph[n] for n in ONTOLOGY} if empty else {n: cut(t) for n, t in O.evolve({n: graph[n] for n in ONTOLOGY}, proposed, revision).items()}
    # entities with their canonical type, the meeting of each note first
    entities = good.select("note_id", F.posexplode("x.entities").alias("at", "e")).select("note_id", (F.col("at") + 1).alias("at"), "e.*")
    canonical = O.canonical_keys(entities.select("type_key"), onto["entity_types"], onto["entity_type_aliases"])
    entities = entities.join(canonical, "type_key").drop("type_key").withColumnRenamed("canonical", "type_key")
    titled = good.select("note_id").join(notes.select("note_id", "title"), "note_id", "left").select("note_id", F.coalesce(F.nullif(F.col("title"), F.lit("")), F.lit("Untitled meeting")).alias("note_title"))
    own = evidence.filter("is_active").groupBy("note_id").agg(F.min_by("evidence_id", F.struct(F.when(F.col("unit_kind") == "summary", 0).otherwise(1), "unit_index")).alias("first_evidence"))
    meetings = titled.join(own, "note_id").select("note_id", F.lit(0).alias("at"), F.lit("_source_meeting").alias("local_id"), F.lit("meeting").alias("type_key"), F.col("note_title").alias("name"), F.array("first_evidence").alias("evidence_ids"))
    rows = entities.unionByName(meetings, allowMissingColumns=True).join(titled, "note_id")
    is_meeting = F.col("type_key") == "meeting"
    scopes = onto["entity_types"].select("type_key", "identity_scope")
    rows = rows.join(scopes, "type_key", "left").withColumns({
        "name": F.when(is_meeting, F.col("note_title")).otherwise(F.col("name")),
        "identifiers": F.when(is_meeting, F.array(F.struct(F.lit("note_id").alias("field_key"), F.col("note_id").alias("value")))).otherwise(F.col("identifiers")),
        "scope_note_id": F.when(F.col("identity_scope") == "note", F.col("note_id")),
        # candidates are in the order of note and place
        "candidate_no": F.concat_ws("\u0001", "note_id", F.lpad(F.col("at").cast("string"), 9, "0")),
    })
    rows = cut(rows)
    wrong_scope = rows.select("note_id", "candidate_no").join(scope_errors(rows.select("candidate_no", "type_key", "scope_note_id"), onto["entity_types"]), "candidate_no").select("note_id", "error")
    used_ids = rows.select("note_id", "type_key", F.explode("identifiers").alias("i")).select("note_id", "type_key", "i.field_key")
    used = rows.select("note_id", "type_key", F.explode("properties").alias("p")).select("note_id", "type_key", "p.field_key")
    of_note = lambda some, ids: some.join(O.undeclared_fields(some, onto["field_definitions"], identifiers=ids), ["type_key", "field_key"], "left_semi").select("note_id", F.concat(F.lit("identifier not declared: " if ids else "field not declared: "), "type_key", F.lit("."), "field_key").alias("error"))
    relations = good.select("note_id", F.explode("x.relations").alias("r")).select("note_id", "r.*")
    ends = rows.select("note_id", F.concat_ws("\u0001", "note_id", "local_id").alias("entity_id"), "type_key")
    asked = relations.select("note_id", F.concat_ws("\u0001", "note_id", "source_local_id").alias("source"), "relation_key", F.concat_ws("\u0001", "note_id", "target_local_id").alias("target"))
    wrong = asked.join(O.wrong_endpoints(asked, ends, onto["relation_types"]).distinct(), ["source", "relation_key", "target"], "left_semi").select("note_id", F.concat(F.lit("relation between other types: "), "relation_key").alias("error"))
    invalid = cut(wrong_scope.unionByName(of_note(used_ids, True)).unionByName(of_note(used, False)).unionByName(wrong).groupBy("note_id").agg(F.min("error").alias("error")))
    rows = rows.join(invalid, "note_id", "left_anti")
    # resolution
    found = cut(resolve(rows.select("candidate_no", "type_key", "name", "note_id", "scope_note_id", "identifiers"), graph, meeting_prefix=meeting_prefix))
    torn = rows.join(found.filter("entity_id is null"), "candidate_no").select("note_id", F.lit("identifiers of several entities").alias("error")).distinct()
    rejected = cut(missing.unionByName(invalid).unionByName(torn))
    known = cut(rows.join(found.filter("entity_id is not null"), "candidate_no").join(rejected, "note_id", "left_anti"))
    applied = good.join(rejected, "note_id", "left_anti").select("note_id", "x")
    order = F.struct("candidate_no")
    new_entities = known.groupBy("entity_id").agg(F.min_by("name", order).alias("canonical_name"), F.min_by("type_key", order).alias("type_key"), F.min_by("scope_note_id", order).alias("scope_note_id")).withColumn("status", F.lit("active")).withColumn("created_at", F.current_timestamp())
    first = F.element_at("evidence_ids", 1)
    aliases = known.select("entity_id", F.lower(F.trim(F.regexp_replace("name", r"\s+", " "))).alias("normalized_alias"), F.col("name").alias("alias"), first.alias("source_evidence_id"), "candidate_no")
    aliases = aliases.groupBy("entity_id", "normalized_alias").agg(F.min_by(F.struct("alias", "source_evidence_id"), "candidate_no").alias("a")).select("entity_id", "normalized_alias", "a.*")
    ids = known.select("entity_id", "evidence_ids", F.explode("identifiers").alias("i")).select("entity_id", "i.field_key", identifier_value(F.col("i.value")).alias("normalized_value"), F.col("i.value").alias("raw_value"), F.explode("evidence_ids").alias("source_evidence_id"))
    facts = known.select("entity_id", "candidate_no", F.posexplode("properties").alias("nth", "p")).select("entity_id", "candidate_no", "nth", "p.field_key", "p.value", "p.confidence", F.explode("p.evidence_ids").alias("evidence_id"))
    facts = facts.select(property_id(F.col("entity_id"), F.col("field_key"), F.col("evidence_id")).alias("property_id"), "entity_id", "field_key", value_json(F.col("value")).alias("value_json"), F.lower(value_text(F.col("value"))).alias("normalized_value"), "confidence", "evidence_id", F.lit(True).alias("is_active"), F.current_timestamp().alias("created_at"), "candidate_no", "nth")
    # of two values of one field with the same evidence the last one counts
    kept = [c for c in facts.columns if c not in ("property_id", "candidate_no", "nth")]
    facts = facts.groupBy("property_id").agg(F.max_by(F.struct(*kept), F.struct("candidate_no", "nth")).alias("f")).select("property_id", "f.*")
    of_local = known.select("note_id", "local_id", "entity_id")
    links = applied.select("note_id", F.explode("x.relations").alias("r")).select("note_id", "r.*")
    links = links.join(of_local.select("note_id", F.col("local_id").alias("source_local_id"), F.col("entity_id").alias("source")), ["note_id", "source_local_id"]).join(
        of_local.select("note_id", F.col("local_id").alias("target_local_id"), F.col("entity_id").alias("target")), ["note_id", "target_local_id"]
    )
    links = links.select("source", F.col("relation_key").alias("relation"), "target", "confidence", F.explode("evidence_ids").alias("evidence_id"))
    links = links.select(edge_id(F.col("source"), F.col("relation"), F.col("target"), F.col("evidence_id")).alias("edge_id"), "source", "relation", "target", "evidence_id", "confidence", F.lit(True).alias("is_active"))
    of_batch = evidence.join(applied.select("note_id"), "note_id", "left_semi").select("evidence_id")
    retired = {t: flag_where(graph[t], of_batch, "evidence_id", "is_active", F.lit(False)) for t in ("entity_properties", "edges")}
    tables = {
        "entities": upsert(graph["entities"], new_entities, ["entity_id"], keep=["canonical_name", "type_key", "status", "scope_note_id", "created_at"]),
        "entity_aliases": insert_or_ignore(graph["entity_aliases"], aliases, ["entity_id", "normalized_alias"]),
        "entity_identifiers": insert_or_ignore(graph["entity_identifiers"], ids, ["entity_id", "field_key", "normalized_value", "source_evidence_id"]),
        "entity_properties": upsert(retired["entity_properties"], facts, ["property_id"], keep=["created_at"]),
        "edges": upsert(retired["edges"], links, ["edge_id"]),
    }
    if not empty:
        told = good.filter((F.size("x.ontology.entity_types") > 0) | (F.size("x.ontology.relation_types") > 0)).agg(F.min("note_id").alias("source_note_id"))
        tables |= onto | {"ontology_revisions": revisions.unionByName(told.select(F.lit(revision).alias("revision"), F.lit("extraction").alias("reason"), "source_note_id"))}
    if runs is not None:
        done = runs.join(applied.select("note_id"), "note_id", "left_semi")
        run = uuid5(F.concat_ws(":", F.lit("run"), "note_id", "prompt_version", F.current_timestamp().cast("string")))
        tables["extraction_runs"] = graph["extraction_runs"].unionByName(done.select(run.alias("run_id"), "note_id", "prompt_version", "model_name", *USAGE, F.lit("complete").alias("state"), F.lit(revision).alias("revision")))
    listed = known.groupBy("note_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "entity_id"))), lambda e: e["entity_id"]).alias("ids"))
    return Applied(tables, rejected, listed.select("note_id", F.array_distinct("ids").alias("entity_ids")))
