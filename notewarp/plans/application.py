"""Queries that apply a batch of extractions made from the tables to a graph with a given ontology."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from notewarp.functions.scalar import json_items
from notewarp.operators import ontology as O
from notewarp.operators.extraction import RUNS, USAGE, Applied, apply, contract_errors, parse
from notewarp.operators.materialize import current_notes
from notewarp.operators.merge import with_defaults
from notewarp.operators.resolve import scope_errors
from notewarp.plans.engine import EDGES, ENTITIES, ENTITY_ALIASES, IDENTIFIERS, PROPERTIES, REVISIONS, SOURCE
from notewarp.session import cut, table
from notewarp.streaming import queue as Q


def responses(spark: SparkSession, root: str) -> DataFrame:
    """(note_id, response): a note's extracted entities as the JSON an extractor would return, with a meeting and relations to it."""
    x = table(spark, root, "extracted_entities").filter("note_id is not null")
    place = F.row_number().over(W.partitionBy("note_id").orderBy("record_id"))
    x = x.withColumn("local", F.concat(F.lit("e"), place.cast("string")))
    fact = F.struct(F.lit("local").alias("field_key"), F.col("local_id").alias("value"), "evidence_ids", F.coalesce("confidence", F.lit(0.5)).alias("confidence"))
    entity = F.struct(F.col("local").alias("local_id"), "type_key", "name", F.coalesce("identifiers", F.array().cast("array<struct<field_key:string,value:string>>")).alias("identifiers"), "evidence_ids", F.array(fact).alias("properties"))
    relation = F.when(F.col("type_key") == "person", F.struct(F.col("local").alias("source_local_id"), F.lit("attended").alias("relation_key"), F.lit("m").alias("target_local_id"), "evidence_ids", F.lit(1.0).alias("confidence")))
    per = x.groupBy("note_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("record_id", entity.alias("e")))), lambda s: s["e"]).alias("entities"),
        F.collect_list(relation).alias("relations"),
        F.min_by("evidence_ids", "record_id").alias("ev"),
    )
    none = F.array().cast("array<struct<field_key:string,value:string>>")
    no_facts = F.array().cast("array<struct<field_key:string,value:string,evidence_ids:array<string>,confidence:double>>")
    meeting = F.struct(F.lit("m").alias("local_id"), F.lit("meeting").alias("type_key"), F.lit("The meeting").alias("name"), none.alias("identifiers"), F.col("ev").alias("evidence_ids"), no_facts.alias("properties"))
    ontology = F.struct(F.array().cast("array<struct<key:string>>").alias("entity_types"), F.array().cast("array<struct<key:string>>").alias("relation_types"))
    return per.select("note_id", F.to_json(F.struct(ontology.alias("ontology"), F.concat("entities", F.array(meeting)).alias("entities"), "relations")).alias("response"))


def _graph(spark: SparkSession) -> dict[str, DataFrame]:
    """An empty graph whose ontology knows persons, meetings, companies, projects, topics, and decisions of a note; each has the field `local`."""
    seed = O.seed(spark)
    kinds = [("company", "global"), ("project", "global"), ("topic", "global"), ("decision", "note")]
    types = spark.createDataFrame([(k, k, "", s, 1, 1, False) for k, s in kinds], O.TYPES)
    fields = [(k, "local", "", "", "string", False, 1) for k in ("person", "meeting", "company", "project", "topic", "decision")] + [("company", "website", "", "", "url", True, 1)]
    empty = lambda schema: spark.createDataFrame([], schema)
    return seed | {
        "entity_types": seed["entity_types"].unionByName(types),
        "field_definitions": seed["field_definitions"].unionByName(spark.createDataFrame(fields, O.FIELDS)),
        "entities": empty(ENTITIES), "entity_aliases": empty(ENTITY_ALIASES), "entity_identifiers": empty(IDENTIFIERS), "entity_properties": empty(PROPERTIES), "edges": empty(EDGES),
        "extraction_runs": empty(RUNS), "ontology_revisions": spark.createDataFrame([(1, "seed", None)], REVISIONS),
    }


def batch(spark: SparkSession, root: str) -> Applied:
    read = cut(parse(responses(spark, root)))
    good = read.join(contract_errors(read), "note_id", "left_anti")
    evidence = table(spark, root, "citations").groupBy("note_id", "evidence_id").agg(F.min("citation_no").alias("unit_index")).withColumns({"unit_kind": F.lit("transcript"), "is_active": F.lit(True)})
    notes = current_notes(table(spark, root, "notes")).select(F.col("id").alias("note_id"), "title")
    runs = read.select("note_id", *[F.lit(i).cast("long").alias(c) for i, c in enumerate(USAGE)], F.lit("v1").alias("prompt_version"), F.lit("m").alias("model_name"))
    return apply(_graph(spark), good, evidence, notes, runs=runs)


def applied_entities(spark: SparkSession, root: str) -> DataFrame:
    """(note_id, entity_ids): the entities that each note's extraction speaks of, in order, its meeting first."""
    return batch(spark, root).entity_ids.select("note_id", F.array_join("entity_ids", ",").alias("entity_ids"))


def applied_identifiers(spark: SparkSession, root: str) -> DataFrame:
    """Identifiers of persons and companies after the batch."""
    got = batch(spark, root).tables["entity_identifiers"].filter("field_key <> 'note_id'")
    return got.select("entity_id", "field_key", "normalized_value").distinct()


def applied_edges(spark: SparkSession, root: str) -> DataFrame:
    """Edges after the batch."""
    return batch(spark, root).tables["edges"].select("edge_id", "source", "relation", "target", "evidence_id", "is_active")


def applied_facts(spark: SparkSession, root: str) -> DataFrame:
    """Properties after the batch."""
    return batch(spark, root).tables["entity_properties"].select("property_id", "field_key", "value_json", "normalized_value", F.round("confidence", 6).alias("confidence"), "evidence_id", "is_active")


def applied_runs(spark: SparkSession, root: str) -> DataFrame:
    """Runs of the batch: the notes that were applied."""
    return batch(spark, root).tables["extraction_runs"].select("note_id", "prompt_version", "output_tokens", "state", F.col("revision").cast("long").alias("revision"))


def applied_rejected(spark: SparkSession, root: str) -> DataFrame:
    """Notes of the batch that were left out, with the evidence they haven't got."""
    return batch(spark, root).rejected


def ontology_evolved(spark: SparkSession, root: str) -> DataFrame:
    """Types and their aliases after the tables' type keys were proposed to the seed."""
    keys = table(spark, root, "entities").select("type_key").unionByName(table(spark, root, "extracted_entities").select("type_key")).distinct()
    proposed = {
        "entity_types": keys.select("type_key", F.concat(F.lit("New "), F.col("type_key")).alias("display_name"), F.lit("d").alias("description"), F.lit("note").alias("identity_scope")),
        "field_definitions": keys.select("type_key", F.lit("email").alias("field_key"), F.lit("Mail").alias("display_name"), F.lit("").alias("description"), F.lit("string").alias("data_type"), F.lit(False).alias("is_identifier")),
        "relation_types": keys.select(F.concat(F.lit("of_"), F.col("type_key")).alias("relation_key"), F.lit("x").alias("display_name"), F.lit("").alias("description"), F.col("type_key").alias("source_type_key"), F.lit("business").alias("target_type_key"), F.lit(True).alias("is_directed")),
    }
    got = O.evolve(O.seed(spark), proposed, 2)
    types = got["entity_types"].select(F.lit("type").alias("kind"), F.col("type_key").alias("key"), F.concat_ws("|", "display_name", "identity_scope", F.col("created_revision").cast("string"), F.col("updated_revision").cast("string")).alias("value"))
    aliases = got["entity_type_aliases"].select(F.lit("alias").alias("kind"), F.col("alias_key").alias("key"), F.col("canonical_type_key").alias("value"))
    fields = got["field_definitions"].select(F.lit("field").alias("kind"), F.concat_ws(".", "type_key", "field_key").alias("key"), F.concat_ws("|", "display_name", "data_type", F.col("is_identifier").cast("string")).alias("value"))
    relations = got["relation_types"].select(F.lit("relation").alias("kind"), F.col("relation_key").alias("key"), F.concat_ws("|", "display_name", "source_type_key", "target_type_key").alias("value"))
    return types.unionByName(aliases).unionByName(fields).unionByName(relations)


def next_revision(spark: SparkSession, root: str) -> DataFrame:
    """The revision after those that the tables' types would have been added by, one each."""
    keys = table(spark, root, "entities").select("type_key").distinct()
    revisions = spark.createDataFrame([(1, "seed", None)], REVISIONS).unionByName(keys.select((F.rank().over(W.partitionBy(F.lit(1)).orderBy("type_key")) + 1).alias("revision"), F.lit("proposal").alias("reason"), F.lit(None).cast("string").alias("source_note_id")))
    return O.next_revision(revisions).select(F.col("revision").cast("long").alias("revision"))


def contract_broken(spark: SparkSession, root: str) -> DataFrame:
    """Extractions that break the contract: the tables' own local ids, where a note has one twice, and a confidence above 1 for the rest."""
    x = table(spark, root, "extracted_entities")
    entity = F.struct(F.col("local_id").alias("local_id"), "type_key", "name", F.array().cast("array<struct<field_key:string,value:string>>").alias("identifiers"), "evidence_ids",
                      F.array(F.struct(F.lit("f").alias("field_key"), F.lit(3).alias("value"), "evidence_ids", (F.coalesce("confidence", F.lit(0.0)) + F.lit(0.5)).alias("confidence"))).alias("properties"))
    per = x.groupBy("note_id").agg(F.collect_list(entity).alias("entities"))
    made = per.select("note_id", F.to_json(F.struct(F.lit(None).cast("struct<entity_types:array<string>>").alias("ontology"), "entities", F.array().cast("array<struct<source_local_id:string>>").alias("relations"))).alias("response"))
    return contract_errors(parse(made))


def scopes_checked(spark: SparkSession, root: str) -> DataFrame:
    """Extracted entities whose scope doesn't suit their type: topics and decisions are of a note, but only decisions and persons bring one."""
    x = table(spark, root, "extracted_entities")
    types = x.select("type_key").distinct().filter("type_key <> 'project'").select("type_key", F.when(F.col("type_key").isin("topic", "decision"), "note").otherwise("global").alias("identity_scope"))
    c = x.select(F.col("record_id").alias("candidate_no"), "type_key", F.when(F.col("type_key").isin("decision", "person"), F.col("note_id")).alias("scope_note_id"))
    return scope_errors(c, types).withColumnRenamed("candidate_no", "record_id")


def evidence_items(spark: SparkSession, root: str) -> DataFrame:
    """Evidence ids of the extracted entities that are there, asked for by JSON lists."""
    lists = table(spark, root, "extracted_entities").select("record_id", F.to_json("evidence_ids").alias("j"))
    asked = lists.select("record_id", F.json_array_length("j").cast("long").alias("n"), F.explode(json_items(F.col("j"))).alias("evidence_id"))
    have = table(spark, root, "citations").select("evidence_id").distinct()
    return asked.join(have, "evidence_id", "left_semi").select("record_id", "n", "evidence_id")


def sync_begun(spark: SparkSession, root: str) -> DataFrame:
    """The state when a pass begins: its start is noted, mark and last error stay; a source without a state gets one."""
    at = "2026-09-06 09:00:00"
    state = Q.begin(Q.begin(table(spark, root, "sync_state"), SOURCE, now=at), table(spark, root, "sync_state").first()["source_key"], now=at)
    return state.select("source_key", F.coalesce(F.unix_micros("watermark"), F.lit(0)).alias("mark_us"), F.unix_micros("last_started_at").alias("started_us"), "last_error")


def columns_added(spark: SparkSession, root: str) -> DataFrame:
    """Queue rows of an older schema with the columns they lack."""
    old = table(spark, root, "processing_queue").select("queue_seq", "note_id", "attempts")
    return with_defaults(old, {"attempts": F.lit(9), "force_reprocess": F.lit(False), "state": F.lit("pending")})


_NAMES = "applied_entities applied_identifiers applied_edges applied_facts applied_runs applied_rejected ontology_evolved next_revision contract_broken scopes_checked evidence_items sync_begun columns_added".split()
QUERIES = {n: globals()[n] for n in _NAMES}

_SQ = "trim(regexp_replace(lower({}), '\\s+', ' ', 'g'))"


def _uuid5(name: str) -> str:
    h = f"sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode({name}))"
    return f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || substr('89ab', CAST(('0x' || substr({h}, 17, 1))::INT % 4 + 1 AS INT), 1) || substr({h}, 18, 3) || '-' || substr({h}, 21, 12)"


_GROUP = "('company', 'organization', 'organisation', 'business')"
_APPLIED = f"""WITH RECURSIVE
xx AS (SELECT *, CASE WHEN type_key IN {_GROUP} THEN 'company' ELSE type_key END AS ct, row_number() OVER (PARTITION BY note_id ORDER BY record_id) AS pos FROM extracted_entities),
ev AS (SELECT note_id, evidence_id, min(citation_no) AS u FROM citations GROUP BY 1, 2), fe AS (SELECT note_id, arg_min(evidence_id, u) AS e FROM ev GROUP BY 1),
mi AS (SELECT note_id, evidence_id FROM (SELECT DISTINCT note_id, unnest(evidence_ids) AS evidence_id FROM xx) c WHERE NOT EXISTS (SELECT 1 FROM ev WHERE ev.note_id = c.note_id AND ev.evidence_id = c.evidence_id)),
rj AS (SELECT note_id, 'no such evidence: ' || string_agg(evidence_id, ', ' ORDER BY evidence_id) AS error FROM mi GROUP BY 1),
nt AS (SELECT id AS note_id, arg_max({{'t': title}}, (updated_at, detail_no)).t AS title FROM notes GROUP BY 1),
ok AS (SELECT DISTINCT note_id, coalesce(nullif(title, ''), 'Untitled meeting') AS title FROM xx LEFT JOIN nt USING (note_id) WHERE note_id NOT IN (SELECT note_id FROM rj)),
c0 AS (SELECT note_id, pos, ct, {_SQ.format('name')} AS nm, CASE WHEN ct = 'decision' THEN note_id ELSE '' END AS sc, identifiers, evidence_ids, local_id, confidence FROM xx SEMI JOIN ok USING (note_id) WHERE ct <> 'meeting'),
c AS (SELECT *, row_number() OVER (ORDER BY note_id, pos) AS no FROM c0),
ci AS (SELECT DISTINCT no, 'i' || chr(1) || ct || chr(1) || i.field_key || chr(1) || lower(trim(i.value)) AS key FROM (SELECT no, ct, unnest(identifiers) AS i FROM c) WHERE trim(i.value) <> ''),
k AS (SELECT no, key, true AS is_id FROM ci UNION ALL SELECT no, 'n' || chr(1) || ct || chr(1) || sc || chr(1) || nm, false FROM c),
p AS (SELECT a.no, arg_min(b.no, (NOT a.is_id, b.no)) AS up FROM k a JOIN k b ON b.key = a.key AND b.no < a.no GROUP BY 1),
r AS (SELECT no, up AS root FROM p UNION ALL SELECT r.no, p.up FROM r JOIN p ON p.no = r.root),
bs AS (SELECT no, min(key) AS basis FROM k GROUP BY 1),
id AS (SELECT c.no, {_uuid5('basis')} AS entity_id FROM c LEFT JOIN (SELECT no, min(root) AS root FROM r GROUP BY 1) t USING (no) JOIN bs ON bs.no = coalesce(t.root, c.no)),
mt AS (SELECT note_id, {_uuid5("'note:' || trim(note_id)")} AS entity_id FROM ok),
al AS (SELECT note_id, pos, entity_id FROM c JOIN id USING (no) UNION ALL SELECT note_id, 0, entity_id FROM mt)
"""

ORACLE = {
    "applied_entities": _APPLIED
    + """, d AS (SELECT note_id, entity_id, min(pos) AS pos FROM (SELECT al.* FROM al WHERE pos > 0 OR note_id IN (SELECT note_id FROM fe) UNION ALL SELECT note_id, (SELECT max(pos) + 1 FROM xx x WHERE x.note_id = mt.note_id), entity_id FROM mt) GROUP BY 1, 2)
SELECT note_id, string_agg(entity_id, ',' ORDER BY pos) AS entity_ids FROM d GROUP BY 1""",
    "applied_identifiers": _APPLIED + "SELECT DISTINCT entity_id, string_split(key, chr(1))[3] AS field_key, string_split(key, chr(1))[4] AS normalized_value FROM ci JOIN id USING (no)",
    "applied_edges": _APPLIED
    + f""", l AS (SELECT DISTINCT id.entity_id AS source, 'attended' AS relation, mt.entity_id AS target, unnest(evidence_ids) AS evidence_id FROM c JOIN id USING (no) JOIN mt USING (note_id) WHERE ct = 'person')
SELECT {_uuid5("source || ':' || relation || ':' || target || ':' || evidence_id")} AS edge_id, source, relation, target, evidence_id, true AS is_active FROM l""",
    "applied_facts": _APPLIED
    + f""", f0 AS (SELECT no AS n2, id.entity_id, local_id, coalesce(confidence, 0.5) AS cf, unnest(evidence_ids) AS evidence_id FROM c JOIN id USING (no)),
f AS (SELECT entity_id, evidence_id, arg_max(local_id, n2) AS v, arg_max(cf, n2) AS cf FROM f0 GROUP BY 1, 2),
m AS (SELECT mt.entity_id, x.local_id AS v, coalesce(x.confidence, 0.5) AS cf, x.pos, unnest(x.evidence_ids) AS evidence_id FROM xx x JOIN mt USING (note_id) WHERE ct = 'meeting'),
g AS (SELECT entity_id, evidence_id, v, cf FROM f UNION ALL SELECT entity_id, evidence_id, arg_max(v, pos), arg_max(cf, pos) FROM m GROUP BY 1, 2)
SELECT {_uuid5("entity_id || ':local:' || evidence_id")} AS property_id, 'local' AS field_key, '"' || v || '"' AS value_json, lower(v) AS normalized_value, round(cf, 6) AS confidence, evidence_id, true AS is_active FROM g""",
    "applied_runs": _APPLIED + "SELECT note_id, 'v1' AS prompt_version, CAST(1 AS BIGINT) AS output_tokens, 'complete' AS state, CAST(1 AS BIGINT) AS revision FROM ok",
    "applied_rejected": _APPLIED + "SELECT note_id, error FROM rj",
    "ontology_evolved": f"""WITH ty AS (SELECT DISTINCT type_key AS t FROM (SELECT type_key FROM entities UNION ALL SELECT type_key FROM extracted_entities)),
ca AS (SELECT t, CASE WHEN t IN {_GROUP} THEN (SELECT arg_min(o.t, CASE o.t WHEN 'company' THEN 0 WHEN 'organization' THEN 1 WHEN 'organisation' THEN 2 ELSE 3 END) FROM ty o WHERE o.t IN {_GROUP}) WHEN t = 'initiative' AND 'project' IN (SELECT t FROM ty) THEN 'project' WHEN t = 'subject' AND 'topic' IN (SELECT t FROM ty) THEN 'topic' ELSE t END AS c FROM ty),
bu AS (SELECT coalesce((SELECT min(c) FROM ca WHERE t IN {_GROUP}), 'business') AS b)
SELECT 'type' AS kind, t AS key, 'New ' || t || '|' || CASE WHEN t IN ('meeting', 'person') THEN 'global|1|2' ELSE 'note|2|2' END AS value FROM ca WHERE t = c
UNION ALL SELECT 'type', s.k, s.v FROM (VALUES ('meeting', 'Meeting|global|1|1'), ('person', 'Person|global|1|1')) s(k, v) WHERE s.k NOT IN (SELECT t FROM ty)
UNION ALL SELECT 'alias', t, c FROM ca WHERE t <> c
UNION ALL SELECT DISTINCT 'field', c || '.email', 'Mail|' || CASE WHEN c = 'person' THEN 'email|true' ELSE 'string|false' END FROM ca
UNION ALL SELECT 'field', 'meeting.note_id', 'Note|string|true'
UNION ALL SELECT 'field', 'person.email', 'E-mail|email|true' WHERE 'person' NOT IN (SELECT t FROM ty)
UNION ALL SELECT 'relation', 'of_' || t, 'x|' || c || '|' || b FROM ca, bu
UNION ALL SELECT 'relation', 'attended', 'attended|person|meeting'""",
    "next_revision": "SELECT count(DISTINCT type_key) + 2 AS revision FROM entities",
    "contract_broken": """WITH n AS (SELECT note_id, count(*) > count(DISTINCT local_id) AS twice, bool_or(coalesce(confidence, 0.0) + 0.5 > 1) AS unsure FROM extracted_entities GROUP BY 1)
SELECT note_id, CASE WHEN twice THEN 'repeated_local_id' ELSE 'confidence' END AS error FROM n WHERE twice OR unsure""",
    "scopes_checked": "SELECT record_id, CASE WHEN type_key = 'project' THEN 'unknown type' WHEN type_key = 'topic' THEN 'scope missing' ELSE 'scope not allowed' END AS error FROM extracted_entities WHERE type_key IN ('project', 'topic') OR (type_key = 'person' AND note_id <> '')",
    "evidence_items": "WITH i AS (SELECT record_id, json_array_length(to_json(evidence_ids)) AS n, unnest(evidence_ids) AS evidence_id FROM extracted_entities) SELECT record_id, CAST(n AS BIGINT) AS n, evidence_id FROM i WHERE evidence_id IN (SELECT evidence_id FROM citations)",
    "sync_begun": f"SELECT source_key, epoch_us(watermark) AS mark_us, epoch_us(TIMESTAMP '2026-09-06 09:00:00') AS started_us, last_error FROM sync_state UNION ALL SELECT '{SOURCE}', 0, epoch_us(TIMESTAMP '2026-09-06 09:00:00'), NULL WHERE '{SOURCE}' NOT IN (SELECT source_key FROM sync_state)",
    "columns_added": "SELECT queue_seq, note_id, attempts, false AS force_reprocess, 'pending' AS state FROM processing_queue",
}
