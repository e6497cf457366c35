"""An additive, versioned ontology: seed, equivalent type keys, proposals, validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewarp.functions.scalar import is_key
from notewarp.operators.merge import insert_or_ignore, upsert

# Groups of type keys that mean the same, and the seed.
EQUIVALENT = [["company", "organization", "organisation", "business"], ["project", "initiative"], ["topic", "subject"]]
TYPES = "type_key string, display_name string, description string, identity_scope string, created_revision int, updated_revision int, is_seed boolean"
FIELDS = "type_key string, field_key string, display_name string, description string, data_type string, is_identifier boolean, created_revision int"
RELATIONS = "relation_key string, display_name string, description string, source_type_key string, target_type_key string, is_directed boolean, created_revision int"
ALIASES = "alias_key string, canonical_type_key string, created_revision int"
SEED_TYPES = [("meeting", "Meeting", "A meeting with notes", "global", 1, 1, True), ("person", "Person", "A person", "global", 1, 1, True)]
SEED_FIELDS = [("meeting", "note_id", "Note", "Identifier of the note", "string", True, 1), ("person", "email", "E-mail", "Address", "email", True, 1)]
SEED_RELATIONS = [("attended", "attended", "Took part in a meeting", "person", "meeting", True, 1)]


def seed(spark: SparkSession) -> dict[str, DataFrame]:
    """The tables of revision 1."""
    return {
        "entity_types": spark.createDataFrame(SEED_TYPES, TYPES),
        "field_definitions": spark.createDataFrame(SEED_FIELDS, FIELDS),
        "relation_types": spark.createDataFrame(SEED_RELATIONS, RELATIONS),
        "entity_type_aliases": spark.createDataFrame([], ALIASES),
    }


def canonical_keys(keys: DataFrame, types: DataFrame, aliases: DataFrame, proposed: DataFrame | None = None) -> DataFrame:
    """(type_key, canonical): a stored alias first, then the first member of its group that exists, then the first one `proposed`, else the key."""
    spark = keys.sparkSession
    groups = spark.createDataFrame([(k, m, i) for g in EQUIVALENT for k in g for i, m in enumerate(g)], "type_key string, member string, at int")
    members = types.select(F.col("type_key").alias("member"), F.lit(0).alias("late"))
    if proposed is not None:
        members = members.unionByName(proposed.select(F.col("type_key").alias("member"), F.lit(1).alias("late")))
    existing = groups.join(members.distinct(), "member").groupBy("type_key").agg(F.min_by("member", F.struct("late", "at")).alias("group_key"))
    stored = aliases.groupBy(F.col("alias_key").alias("type_key")).agg(F.min("canonical_type_key").alias("stored"))
    joined = keys.select("type_key").distinct().join(stored, "type_key", "left").join(existing, "type_key", "left")
    return joined.select("type_key", F.coalesce("stored", "group_key", "type_key").alias("canonical"))


def evolve(ontology: dict[str, DataFrame], proposed: dict[str, DataFrame], revision: int) -> dict[str, DataFrame]:
    """The ontology with proposed types, fields and relations at `revision`.

    Known types, fields and relations get a new display name and description; scope, seed flag, data type, identifier flag and
    endpoints stay. A type that is equivalent to a known one becomes its alias and only gives fields; endpoints are rewritten.
    """
    types, aliases = ontology["entity_types"], ontology["entity_type_aliases"]
    names = canonical_keys(proposed["entity_types"], types, aliases, proposed["entity_types"])
    # of two proposed members of a group the first one known or proposed stands for both
    mapped = proposed["entity_types"].join(names, "type_key")
    new_aliases = mapped.filter("type_key <> canonical").select(F.col("type_key").alias("alias_key"), F.col("canonical").alias("canonical_type_key"), F.lit(revision).alias("created_revision"))
    own = mapped.filter("type_key = canonical").select("type_key", "display_name", "description", "identity_scope", F.lit(revision).alias("created_revision"), F.lit(revision).alias("updated_revision"), F.lit(False).alias("is_seed"))
    all_types = upsert(types, own, ["type_key"], keep=["identity_scope", "created_revision", "is_seed"])
    all_aliases = insert_or_ignore(aliases, new_aliases, ["alias_key"])
    to = lambda rows, col: rows.join(canonical_keys(rows.select(F.col(col).alias("type_key")), all_types, all_aliases).withColumnRenamed("type_key", col), col).drop(col).withColumnRenamed("canonical", col)
    fields = to(proposed["field_definitions"], "type_key").withColumn("created_revision", F.lit(revision))
    relations = to(to(proposed["relation_types"], "source_type_key"), "target_type_key").withColumn("created_revision", F.lit(revision))
    return {
        "entity_types": all_types,
        "entity_type_aliases": all_aliases,
        "field_definitions": upsert(ontology["field_definitions"], fields.select(ontology["field_definitions"].columns), ["type_key", "field_key"], keep=["data_type", "is_identifier", "created_revision"]),
        "relation_types": upsert(ontology["relation_types"], relations.select(ontology["relation_types"].columns), ["relation_key"], keep=["source_type_key", "target_type_key", "is_directed", "created_revision"]),
    }


def next_revision(revisions: DataFrame) -> DataFrame:
    """One row: the greatest revision plus one, 1 where there is none."""
    return revisions.agg((F.coalesce(F.max("revision"), F.lit(0)) + 1).alias("revision"))


def bad_keys(keys: DataFrame, column: str) -> DataFrame:
    """Keys that aren't snake case, and keys that are there twice: (key, problem)."""
    shaped = keys.filter(~F.coalesce(is_key(F.col(column)), F.lit(False))).select(F.col(column).alias("key"), F.lit("form").alias("problem"))
    twice = keys.groupBy(column).count().filter("count > 1").select(F.col(column).alias("key"), F.lit("repeated").alias("problem"))
    return shaped.unionByName(twice).distinct()


def undeclared_fields(used: DataFrame, fields: DataFrame, *, identifiers: bool) -> DataFrame:
    """Used (type_key, field_key) that the ontology doesn't declare; with `identifiers` it must declare them as identifiers."""
    known = fields.filter("is_identifier") if identifiers else fields
    return used.select("type_key", "field_key").distinct().join(known, ["type_key", "field_key"], "left_anti")


def wrong_endpoints(relations: DataFrame, entities: DataFrame, relation_types: DataFrame) -> DataFrame:
    """Relations (source, relation_key, target) whose ends aren't of the declared types, or whose key isn't declared."""
    kind = entities.select(F.col("entity_id"), F.col("type_key"))
    typed = relations.join(kind.select(F.col("entity_id").alias("source"), F.col("type_key").alias("from_type")), "source", "left").join(kind.select(F.col("entity_id").alias("target"), F.col("type_key").alias("to_type")), "target", "left")
    declared = relation_types.select("relation_key", F.col("source_type_key").alias("from_type"), F.col("target_type_key").alias("to_type"))
    return typed.join(declared, ["relation_key", "from_type", "to_type"], "left_anti").select("source", "relation_key", "target")


def missing_evidence(cited: DataFrame, evidence: DataFrame) -> DataFrame:
    """(note_id, missing): evidence ids cited for a note that aren't among its active ones, in order."""
    gone = cited.select("note_id", F.explode("evidence_ids").alias("evidence_id")).distinct().join(evidence.filter("is_active").select("note_id", "evidence_id"), ["note_id", "evidence_id"], "left_anti")
    return gone.groupBy("note_id").agg(F.array_sort(F.collect_set("evidence_id")).alias("missing"))
