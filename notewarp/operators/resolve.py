"""Entity resolution: identifier, then unique name, then unique alias, else a new entity; against the stored graph and within a batch.

All steps are joins on keys. A candidate's keys are its identifiers and its name within type and scope. What the stored entities have
under those keys decides first: identifiers (whatever the scope), the note for meetings, one entity of that name, one with that alias.
Of what is left, the candidate with the least number that has a key introduces it, and a later one hangs on the introducer of one of its
identifiers, or else of its name; pointers are doubled up to the first candidate, so a hot key is never one task's work. That one's
entity is theirs, or a new one, whose id is made from the first candidate's least key.

Defined results: stored entities that aren't active don't match by identifier, name or alias; several entities under a candidate's
identifiers, stored or from earlier candidates, are a conflict (`match_source` is `conflict`, no id), and its keys count no more; a name
that several stored entities bear links nothing; of an alias that several new entities got in one batch the first one counts; blank
identifier values are ignored; candidates without number or type are left out; exact copies are one candidate; of a new entity the
candidate with the least number is `created`, the others have found it. The order of rows doesn't matter, numbers do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewarp.functions.scalar import MEETING_PREFIX, meeting_id, uuid5
from notewarp.functions.text import normalize_text
from notewarp.session import cut, cut_counted

#: Rounds of hooking are logarithmic in a group's size; more of them are an error, never a partial result.
MAX_ROUNDS = 64
_SEP = "\u0001"
_NO_IDS = "array<struct<field_key:string,value:string>>"


def identifier_value(value: Column) -> Column:
    """Form in which identifiers are compared."""
    return F.lower(F.trim(value))


def name_key(type_key: Column, scope: Column, name: Column) -> Column:
    return F.concat_ws(_SEP, F.lit("n"), type_key, F.coalesce(scope, F.lit("")), name)


def identifier_key(type_key: Column, field: Column, value: Column) -> Column:
    return F.concat_ws(_SEP, F.lit("i"), type_key, field, value)


def scope_errors(candidates: DataFrame, types: DataFrame) -> DataFrame:
    """(candidate_no, error) of candidates of an unknown type, of a note's own type without a note, and of a global type with one."""
    scoped = candidates.join(types.groupBy("type_key").agg(F.first("identity_scope").alias("identity_scope")), "type_key", "left")
    has = F.coalesce(F.col("scope_note_id"), F.lit("")) != ""
    error = F.when(F.col("identity_scope").isNull(), "unknown type").when((F.col("identity_scope") == "note") & ~has, "scope missing").when((F.col("identity_scope") != "note") & has, "scope not allowed")
    return scoped.select("candidate_no", error.alias("error")).filter("error is not null")


def stored_keys(known: dict[str, DataFrame]) -> DataFrame:
    """(key, how, n, entity_id): how many active entities stand under each key, and the least of them; `how` is i, n or a."""
    entities = known["entities"]
    if "scope_note_id" not in entities.columns:
        entities = entities.withColumn("scope_note_id", F.lit(None).cast("string"))
    active = entities.filter("status = 'active'").select("entity_id", "type_key", "scope_note_id", "canonical_name")
    names = active.select(name_key(F.col("type_key"), F.col("scope_note_id"), normalize_text(F.col("canonical_name"))).alias("key"), F.lit("n").alias("how"), "entity_id")
    ends = active.drop("canonical_name")
    aliases = known["entity_aliases"].join(ends, "entity_id").select(name_key(F.col("type_key"), F.col("scope_note_id"), normalize_text(F.col("alias"))).alias("key"), F.lit("a").alias("how"), "entity_id")
    ids = known["entity_identifiers"].join(ends, "entity_id").select(identifier_key(F.col("type_key"), F.col("field_key"), F.col("normalized_value")).alias("key"), F.lit("i").alias("how"), "entity_id")
    return names.unionByName(aliases).unionByName(ids).groupBy("key", "how").agg(F.count_distinct("entity_id").alias("n"), F.min("entity_id").alias("entity_id"))


def roots(parents: DataFrame) -> DataFrame:
    """(no, root) of a forest (no, parent), parent null at a root: pointers are doubled until all end at a root."""
    at = cut(parents.select("no", F.coalesce("parent", "no").alias("root")))
    for _ in range(MAX_ROUNDS):
        further = at.withColumnRenamed("no", "through").withColumnRenamed("root", "beyond")
        moved, changed = cut_counted(at.join(further, F.col("root") == F.col("through")).select("no", F.col("beyond").alias("root"), (F.col("beyond") != F.col("root")).alias("moved")), F.col("moved"))
        at = moved.select("no", "root")
        if not changed:
            return at
    raise RuntimeError(f"candidates aren't settled after {MAX_ROUNDS} rounds")


def resolve(candidates: DataFrame, known: dict[str, DataFrame] | None = None, *, meeting_prefix: str = MEETING_PREFIX) -> DataFrame:
    """(candidate_no, entity_id, match_source).

    `candidates` is (candidate_no of any type with an order, type_key, name, note_id?, scope_note_id?, identifiers array<struct<field_key,value>>); `known` has the
    stored tables `entities`, `entity_aliases` and `entity_identifiers`, none where nothing is stored.
    """
    spark = candidates.sparkSession
    given = F.filter(F.coalesce("identifiers", F.array().cast(_NO_IDS)), lambda i: F.trim(i["value"]) != "")
    ids = F.array_sort(F.array_distinct(F.transform(given, lambda i: identifier_key(F.col("type_key"), i["field_key"], identifier_value(i["value"])))))
    rows = candidates.filter("candidate_no is not null and type_key is not null").select("candidate_no", "type_key", "note_id", "scope_note_id", normalize_text(F.coalesce("name", F.lit(""))).alias("name_norm"), ids.alias("ids"))
    rows = rows.withColumn("note_id", F.when(F.col("type_key") == "meeting", F.trim("note_id")))
    rows = cut(rows.withColumn("copy", F.sha2(F.to_json(F.struct("type_key", F.coalesce("note_id", F.lit("")), F.coalesce("scope_note_id", F.lit("")), "name_norm", "ids")), 256)))
    rest = ["type_key", "note_id", "scope_note_id", "name_norm", "ids"]
    copies = cut(rows.groupBy("copy").agg(F.min("candidate_no").alias("no"), *[F.first(c).alias(c) for c in rest]))
    by_note = (F.col("type_key") == "meeting") & (F.coalesce("note_id", F.lit("")) != "")
    own_name = name_key(F.col("type_key"), F.col("scope_note_id"), F.col("name_norm"))
    keys = cut(copies.select("no", F.explode("ids").alias("key"), F.lit(True).alias("is_id")).unionByName(copies.filter(~by_note).select("no", own_name.alias("key"), F.lit(False).alias("is_id"))))
    stored = stored_keys(known) if known else spark.createDataFrame([], "key string, how string, n long, entity_id string")
    of = lambda how, col: F.when(F.col("how") == how, F.col(col))
    under = keys.join(stored, "key").groupBy("no").agg(
        F.max(of("i", "n")).alias("id_n"), F.min(of("i", "entity_id")).alias("id_least"), F.max(of("i", "entity_id")).alias("id_most"),
        F.max(of("n", "n")).alias("name_n"), F.max(of("n", "entity_id")).alias("by_name"), F.max(of("a", "n")).alias("alias_n"), F.max(of("a", "entity_id")).alias("by_alias"),
    )
    source = (
        F.when((F.col("id_n") > 1) | (F.col("id_least") != F.col("id_most")), "conflict").when(F.col("id_least").isNotNull(), "exact_identifier").when(by_note, "meeting")
        .when(F.col("name_n") == 1, "exact_name").when((F.coalesce("name_n", F.lit(0)) == 0) & (F.col("alias_n") == 1), "exact_alias")
    )
    entity = F.when(F.col("source") == "exact_identifier", F.col("id_least")).when(F.col("source") == "meeting", meeting_id(F.col("note_id"), prefix=meeting_prefix)).when(F.col("source") == "exact_name", F.col("by_name")).when(F.col("source") == "exact_alias", F.col("by_alias"))
    decided = copies.join(under, "no", "left").withColumn("source", source).withColumn("entity_id", entity)
    decided = cut(decided.select("no", "copy", "name_norm", "source", "entity_id", (F.coalesce("name_n", "alias_n", F.lit(0)) > 1).alias("ambiguous"), F.array_min(F.concat("ids", F.array(own_name))).alias("basis")))
    for _ in range(MAX_ROUNDS):
        # the first candidate with a key introduces it; a later one hangs on the first of its identifiers' introducers, or its name's
        taking = keys.join(decided.filter("source is null or source <> 'conflict'").select("no", "ambiguous", F.col("source").isNull().alias("open")), "no")
        first = taking.groupBy("key").agg(F.min("no").alias("parent"))
        earlier = cut(taking.join(first, "key").filter("parent < no"))
        by = earlier.filter("open and (is_id or not ambiguous)").groupBy("no").agg(F.min(F.when(F.col("is_id"), F.col("parent"))).alias("by_id"), F.min(F.when(~F.col("is_id"), F.col("parent"))).alias("by_name"))
        placed = cut(decided.join(by, "no", "left"))
        at = roots(placed.select("no", F.when(F.col("source").isNull(), F.coalesce("by_id", "by_name")).alias("parent")))
        # a new entity's id is made from the least key of its first candidate; an ambiguous name is told apart by the candidate
        made = uuid5(F.when(F.col("ambiguous"), F.concat_ws(_SEP, "basis", "copy")).otherwise(F.col("basis")))
        ends = placed.select(F.col("no").alias("root"), F.coalesce("entity_id", made).alias("its"), F.col("name_norm").alias("root_name"), F.col("source").alias("root_source"))
        settled = cut(placed.join(at, "no").join(ends, "root"))
        its = settled.select(F.col("no").alias("parent"), "its")
        split = earlier.filter("is_id").join(its, "parent").groupBy("no").agg(F.min("its").alias("least"), F.max("its").alias("most"))
        split = split.join(decided.select("no", F.when(F.col("source") == "exact_identifier", F.col("entity_id")).alias("own")), "no").filter("least <> most or own <> least")
        decided, torn = cut_counted(decided.join(split.select("no", F.lit(True).alias("torn")), "no", "left").select("no", "copy", "name_norm", F.when(F.col("torn"), "conflict").otherwise(F.col("source")).alias("source"), F.when(F.col("torn").isNull(), F.col("entity_id")).alias("entity_id"), "ambiguous", "basis", "torn"), F.col("torn"))
        decided = decided.drop("torn")
        if not torn:
            break
    else:
        raise RuntimeError(f"conflicts aren't settled after {MAX_ROUNDS} rounds")
    exists = known["entities"].select(F.col("entity_id").alias("its"), F.lit(True).alias("exists")).distinct() if known else spark.createDataFrame([], "its string, exists boolean")
    by_what = F.when(F.col("root_source").isNull() & (F.col("name_norm") == F.col("root_name")), "exact_name").otherwise("exact_alias")
    settled = settled.select("copy", "no", "root", "source", "its", "root_source", F.col("by_id").isNotNull().alias("linked_by_id"), by_what.alias("by_what")).join(exists, "its", "left")
    result = rows.select("candidate_no", "copy", F.size("ids").alias("n_ids")).join(settled, "copy")
    firsts = settled.filter("source = 'meeting'").groupBy("its").agg(F.min("no").alias("first_meeting"))
    result = result.join(firsts, "its", "left")
    shown = (
        F.when(F.col("source") == "meeting", F.when(F.col("exists").isNull() & (F.col("candidate_no") == F.col("first_meeting")), "created").otherwise("exact_identifier"))
        .when(F.col("source").isNotNull(), F.col("source"))
        .when((F.col("no") == F.col("root")) & (F.col("candidate_no") == F.col("no")), "created")
        .when(F.col("linked_by_id") | (F.col("n_ids") > 0) & (F.col("candidate_no") > F.col("no")), "exact_identifier")
        .otherwise(F.col("by_what"))
    )
    return result.select("candidate_no", F.when(F.coalesce("source", F.lit("")) != "conflict", F.col("its")).alias("entity_id"), shown.alias("match_source"))
