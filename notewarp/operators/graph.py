"""Graph queries: hops, bounded simple-path traversal, entity detail, citations, overview.

Edges are (source, relation, target, evidence_id). Results are small by their limits; what is read is pruned by the start node.

Defined results: null ids never match; repeated edges give repeated paths that collapse to one neighbour; the start node can only
come back through a loop edge on itself; ties go by id, relation and direction.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewarp.functions.scalar import clamp
from notewarp.session import cut, cut_counted

# Bounds of a traversal and of the overview.
DEFAULT_DEPTH, MAX_DEPTH = 2, 3
DEFAULT_LIMIT, MAX_LIMIT = 100, 100
OVERVIEW_NODES = 300
#: Nodes up to which a front is sent to every task (some 100 bytes each).
BROADCAST_PATHS = 100_000


def hops(edges: DataFrame) -> DataFrame:
    """(here, there, relation, direction, evidence_id): every edge from both ends, so that a step is an equi-join."""
    out = edges.select(F.col("source").alias("here"), F.col("target").alias("there"), "relation", F.lit("outgoing").alias("direction"), "evidence_id")
    back = edges.select(F.col("target").alias("here"), F.col("source").alias("there"), "relation", F.lit("incoming").alias("direction"), "evidence_id")
    return out.unionByName(back)


def expansion(edges: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A function from a front (here, ...) to its hops (the front's columns, there, relation, direction, evidence_id)."""
    step = hops(edges.filter("is_active") if "is_active" in edges.columns else edges)
    return lambda front: front.join(step, "here")


def traverse(edges: DataFrame | Callable[[DataFrame], DataFrame], nodes: DataFrame, start: str, *, depth: int = DEFAULT_DEPTH, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """(entity_id, canonical_name, type_key, relation_key, direction, depth, evidence_id) of the neighbours on simple paths from `start`.

    `edges` may have is_active, or is a function that expands a front; `nodes` (entity_id, canonical_name, type_key) may have status;
    inactive nodes are walked through, not shown.

    A node is expanded once, at its least depth: what a later path through it reaches has been reached before. Of the nodes before it a
    front keeps the least and the greatest only: a hop that leads back to one of them is still on a simple path through the other. So
    paths are never listed, and a front has one row a node; with at most MAX_DEPTH steps this is exact.
    """
    expand = edges if callable(edges) else expansion(edges)
    spark = nodes.sparkSession
    kept = ["there", "relation", "direction", "evidence_id"]
    first = cut(expand(spark.createDataFrame([(start,)], "here string")).select(*kept))
    walks = first.withColumn("depth", F.lit(1))
    reached = first.filter(F.col("there") != start).select(F.col("there").alias("here")).distinct()
    front, seen = reached.select("here", F.lit(None).cast("string").alias("b1"), F.lit(None).cast("string").alias("b2")), reached
    for d in range(2, clamp(depth, 1, MAX_DEPTH) + 1):
        # a small front is sent to the edges, which are then only scanned; a large one is joined by a shuffle
        front, n = cut_counted(front)
        walk = expand(F.broadcast(front) if n <= BROADCAST_PATHS else front)
        back = (F.col("there") == F.col("b1")) & (F.col("b2").isNull() | (F.col("b2") == F.col("b1")))
        walk = cut(walk.filter((F.col("there") != start) & (F.col("there") != F.col("here")) & ~F.coalesce(back, F.lit(False))).select("here", *kept))
        walks = walks.unionByName(walk.select(*kept, F.lit(d).alias("depth")))
        if d < MAX_DEPTH:
            ways = walk.groupBy("there").agg(F.min("here").alias("b1"), F.max("here").alias("b2"))
            front = ways.join(seen.withColumnRenamed("here", "there"), "there", "left_anti").select(F.col("there").alias("here"), "b1", "b2")
            seen = seen.unionByName(front.select("here"))
    near = walks.groupBy("there", "relation", "direction").agg(F.min("depth").alias("depth"), F.min_by("evidence_id", F.struct("depth", "evidence_id")).alias("evidence_id"))
    if "status" in nodes.columns:
        nodes = nodes.filter("status = 'active'")
    shown = near.join(nodes.select(F.col("entity_id").alias("there"), "canonical_name", "type_key"), "there")
    shown = shown.select(F.col("there").alias("entity_id"), "canonical_name", "type_key", F.col("relation").alias("relation_key"), "direction", "depth", "evidence_id")
    return shown.orderBy("depth", "canonical_name", "entity_id", "relation_key", "direction").limit(clamp(limit, 1, MAX_LIMIT))


def citations(evidence: DataFrame, notes: DataFrame) -> DataFrame:
    """Visible evidence with its note: active evidence of active notes."""
    shown = notes.filter("visibility = 'active'").select("note_id", F.col("title").alias("note_title"), "web_url")
    return (
        evidence.filter("is_active")
        .join(shown, "note_id")
        .select("evidence_id", "note_id", F.coalesce("note_title", F.lit("Untitled meeting")).alias("note_title"), "web_url", F.col("content").alias("excerpt"), "speaker_name", "started_at", "ended_at")
    )


def entity_detail(entities: DataFrame, aliases: DataFrame, identifiers: DataFrame, properties: DataFrame, evidence: DataFrame, notes: DataFrame, entity_id: str) -> DataFrame:
    """One row: entity, aliases, identifiers, and the properties whose evidence is visible with their citations. None if it isn't active.

    Each side is filtered by the id before it is joined, so one entity's rows are all that moves.
    """
    one = entities.filter((F.col("entity_id") == entity_id) & (F.col("status") == "active")).select("entity_id", "type_key", "canonical_name")
    names = aliases.filter(F.col("entity_id") == entity_id).groupBy("entity_id").agg(F.transform(F.array_sort(F.collect_set(F.struct("normalized_alias", "alias"))), lambda x: x["alias"]).alias("aliases"))
    ids = identifiers.filter(F.col("entity_id") == entity_id).groupBy("entity_id").agg(
        F.transform(F.array_sort(F.collect_set(F.struct("field_key", "normalized_value", "raw_value"))), lambda x: F.struct(x["field_key"].alias("field_key"), x["raw_value"].alias("raw_value"))).alias("identifiers")
    )
    cited = properties.filter((F.col("entity_id") == entity_id) & F.col("is_active")).join(citations(evidence, notes), "evidence_id")
    citation = F.struct("evidence_id", "note_id", "note_title", "web_url", "excerpt", "speaker_name", "started_at", "ended_at")
    # field ascending, newest first
    facts = cited.groupBy("entity_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("field_key", (-F.unix_micros("created_at")).alias("newest"), "property_id", F.struct("field_key", "value_json", "confidence", citation.alias("citation")).alias("fact")))),
            lambda x: x["fact"],
        ).alias("properties")
    )
    return one.join(names, "entity_id", "left").join(ids, "entity_id", "left").join(facts, "entity_id", "left")


def panel(edges: DataFrame, nodes: DataFrame, entity_id: str) -> DataFrame:
    """(relation, direction, other_id, other_name): the edges at one entity with who is at their other end, `Unknown` where nobody is."""
    here = hops(edges.filter("is_active") if "is_active" in edges.columns else edges).filter(F.col("here") == entity_id)
    names = nodes.select(F.col("entity_id").alias("there"), "canonical_name")
    shown = here.join(names, "there", "left").select("relation", "direction", F.col("there").alias("other_id"), F.coalesce("canonical_name", F.lit("Unknown")).alias("other_name"))
    return shown.distinct().orderBy("relation", "direction", "other_name", "other_id")


def overview(entities: DataFrame, edges: DataFrame, *, nodes: int = OVERVIEW_NODES) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): the most recent active entities and the active edges between them; `nodes` has `truncated`."""
    chosen = entities.filter("status = 'active'").orderBy(F.desc("updated_at"), "entity_id").limit(nodes).select(F.col("entity_id").alias("id"), F.col("canonical_name").alias("name"), F.col("type_key").alias("type"))
    ids = F.broadcast(chosen.select("id"))  # at most OVERVIEW_NODES rows
    if "is_active" in edges.columns:
        edges = edges.filter("is_active")
    inside = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    full = F.broadcast(chosen.agg((F.count("*") >= nodes).alias("truncated"), F.lit(1).alias("one")))
    return chosen.withColumn("one", F.lit(1)).join(full, "one").drop("one"), inside.select("source", "relation", "target", "evidence_id")
