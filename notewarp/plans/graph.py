"""Graph queries: the star tables as a graph of entities, and the notes as their evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewarp.operators.graph import citations, entity_detail, hops, overview, panel, traverse
from notewarp.session import table


def nodes(spark: SparkSession, root: str) -> DataFrame:
    """(entity_id, canonical_name, type_key, status, updated_at) of regions, nations, customers, suppliers, parts and orders."""

    def kind(name: str, key: str, label, status=None, at=None) -> DataFrame:
        t = table(spark, root, name)
        return t.select(
            F.concat(F.lit(f"{name}:"), F.col(key).cast("string")).alias("entity_id"),
            label.cast("string").alias("canonical_name"),
            F.lit(name).alias("type_key"),
            (status if status is not None else F.lit("active")).alias("status"),
            (at if at is not None else F.lit("2026-01-01")).cast("timestamp").alias("updated_at"),
        )

    shut = F.when(F.col("o_orderstatus") == "F", "merged").otherwise("active")
    all_of = [
        kind("region", "r_regionkey", F.col("r_name")),
        kind("nation", "n_nationkey", F.col("n_name")),
        kind("customer", "c_custkey", F.col("c_name")),
        kind("supplier", "s_suppkey", F.col("s_name")),
        kind("part", "p_partkey", F.col("p_name")),
        kind("orders", "o_orderkey", F.concat(F.lit("order "), F.col("o_orderkey").cast("string")), shut, F.col("o_orderdate")),
    ]
    rows = all_of[0]
    for r in all_of[1:]:
        rows = rows.unionByName(r)
    return rows


def _key(*columns: str):
    return F.concat_ws(":", *[F.col(c).cast("string") for c in columns])


#: (table, type and key of the source, relation, type and key of the target, columns of the evidence id, its prefix).
RELATIONS = [
    ("customer", "customer", "c_custkey", "located_in", "nation", "c_nationkey", ("c_custkey",), "c:"),
    ("supplier", "supplier", "s_suppkey", "located_in", "nation", "s_nationkey", ("s_suppkey",), "s:"),
    ("nation", "nation", "n_nationkey", "part_of", "region", "n_regionkey", ("n_nationkey",), "n:"),
    ("orders", "customer", "o_custkey", "placed", "orders", "o_orderkey", ("o_orderkey",), "o:"),
    ("lineitem", "orders", "l_orderkey", "contains", "part", "l_partkey", ("l_orderkey", "l_linenumber"), "l:"),
    ("lineitem", "supplier", "l_suppkey", "supplies", "part", "l_partkey", ("l_orderkey", "l_linenumber"), "l:"),
]


def _active(name: str):
    return F.col("l_returnflag") != "R" if name == "lineitem" else F.lit(True)


def edges(spark: SparkSession, root: str) -> DataFrame:
    """(source, relation, target, evidence_id, is_active) between those entities."""
    rows = None
    for name, of, key, relation, to, other, evidence, prefix in RELATIONS:
        part = table(spark, root, name).select(
            F.concat(F.lit(f"{of}:"), _key(key)).alias("source"), F.lit(relation).alias("relation"), F.concat(F.lit(f"{to}:"), _key(other)).alias("target"), F.concat(F.lit(prefix), _key(*evidence)).alias("evidence_id"), _active(name).alias("is_active")
        )
        rows = part if rows is None else rows.unionByName(part)
    return rows


def expand(spark: SparkSession, root: str):
    """The hops of a front by typed keys: each table is scanned once per end of a relation and joined on its numbers; ids are spelled afterwards."""

    def hops_of(front: DataFrame) -> DataFrame:
        typed = front.withColumns({"__type": F.substring_index("here", ":", 1), "__key": F.substring_index("here", ":", -1).cast("long")})
        rows = None
        for name, of, key, relation, to, other, evidence, prefix in RELATIONS:
            for direction, here_type, here, there_type, there in (("outgoing", of, key, to, other), ("incoming", to, other, of, key)):
                t = table(spark, root, name).filter(_active(name))
                found = t.join(typed.filter(F.col("__type") == here_type), F.col(here) == F.col("__key"))
                part = found.select(*front.columns, F.concat(F.lit(f"{there_type}:"), _key(there)).alias("there"), F.lit(relation).alias("relation"), F.lit(direction).alias("direction"), F.concat(F.lit(prefix), _key(*evidence)).alias("evidence_id"))
                rows = part if rows is None else rows.unionByName(part)
        return rows

    return hops_of


def traverse_nation(spark: SparkSession, root: str) -> DataFrame:
    """Two steps around nation 7."""
    return traverse(expand(spark, root), nodes(spark, root), "nation:7")


def traverse_customer(spark: SparkSession, root: str) -> DataFrame:
    """Three steps around customer 12."""
    return traverse(expand(spark, root), nodes(spark, root), "customer:12", depth=99)


def hop_degrees(spark: SparkSession, root: str) -> DataFrame:
    """Steps by relation and direction."""
    return hops(edges(spark, root).filter("is_active")).groupBy("relation", "direction").agg(F.count("*").alias("n"))


def relation_panel(spark: SparkSession, root: str) -> DataFrame:
    """Who is at the other end of the relations of nation 7."""
    return panel(edges(spark, root), nodes(spark, root), "nation:7")


def overview_nodes(spark: SparkSession, root: str) -> DataFrame:
    """The most recent active entities."""
    return overview(nodes(spark, root), edges(spark, root))[0]


def overview_edges(spark: SparkSession, root: str) -> DataFrame:
    """Active edges among the most recent entities, where places and suppliers were stored last."""
    late = F.when(F.col("type_key").isin("region", "nation", "supplier"), F.lit("2027-01-01").cast("timestamp")).otherwise(F.col("updated_at"))
    return overview(nodes(spark, root).withColumn("updated_at", late), edges(spark, root))[1]


def part_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Aliases, identifiers, properties (entity-attribute-value), evidence and notes of the parts."""
    part, line, orders = table(spark, root, "part"), table(spark, root, "lineitem"), table(spark, root, "orders")
    pid = F.concat(F.lit("part:"), F.col("p_partkey").cast("string"))
    fields = F.expr("stack(3, 'brand', to_json(struct(p_brand as v)), 'type', to_json(struct(p_type as v)), 'size', to_json(struct(p_size as v))) as (field_key, value_json)")
    evidence = line.select(
        F.concat_ws(":", F.lit("l"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("evidence_id"),
        F.col("l_orderkey").cast("string").alias("note_id"),
        F.concat_ws(" ", F.lit("line"), F.col("l_linenumber").cast("string")).alias("content"),
        F.lit(None).cast("string").alias("speaker_name"),
        F.col("l_shipdate").cast("timestamp").alias("started_at"),
        F.lit(None).cast("timestamp").alias("ended_at"),
        (F.col("l_linestatus") == "O").alias("is_active"),
        "l_partkey",
    )
    facts = part.select("p_partkey", fields).join(evidence.select("evidence_id", F.col("l_partkey").alias("p_partkey"), F.col("started_at").alias("created_at")), "p_partkey")
    return {
        "aliases": part.select(pid.alias("entity_id"), F.lower("p_name").alias("normalized_alias"), F.col("p_name").alias("alias")),
        "identifiers": part.select(pid.alias("entity_id"), F.lit("partkey").alias("field_key"), F.col("p_partkey").cast("string").alias("normalized_value"), F.col("p_partkey").cast("string").alias("raw_value")),
        "properties": facts.select(pid.alias("entity_id"), F.concat_ws(":", "field_key", "evidence_id").alias("property_id"), "field_key", "value_json", F.lit(0.9).alias("confidence"), "evidence_id", F.lit(True).alias("is_active"), "created_at"),
        "evidence": evidence.drop("l_partkey"),
        "notes": orders.select(F.col("o_orderkey").cast("string").alias("note_id"), F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("title"), F.concat(F.lit("https://orders.example/"), F.col("o_orderkey").cast("string")).alias("web_url"), F.when(F.col("o_orderstatus") == "P", "hidden").otherwise("active").alias("visibility")),
    }


def part_detail(spark: SparkSession, root: str) -> DataFrame:
    """Entity detail of part 5, its lists as text."""
    t = part_tables(spark, root)
    one = entity_detail(nodes(spark, root), t["aliases"], t["identifiers"], t["properties"], t["evidence"], t["notes"], "part:5")
    facts = F.transform("properties", lambda p: F.concat_ws("|", p["field_key"], p["value_json"], p["citation"]["evidence_id"], p["citation"]["note_title"]))
    return one.select("entity_id", "type_key", "canonical_name", F.array_join("aliases", ";").alias("aliases"), F.array_join(F.transform("identifiers", lambda i: F.concat_ws("=", i["field_key"], i["raw_value"])), ";").alias("identifiers"), F.coalesce(F.array_join(facts, ";"), F.lit("")).alias("properties"))


def visible_citations(spark: SparkSession, root: str) -> DataFrame:
    """Citations of active evidence of active notes."""
    t = part_tables(spark, root)
    return citations(t["evidence"], t["notes"]).select("evidence_id", "note_id", "note_title", "web_url", "excerpt")


QUERIES = {
    "traverse_nation": traverse_nation,
    "traverse_customer": traverse_customer,
    "hop_degrees": hop_degrees,
    "relation_panel": relation_panel,
    "overview_nodes": overview_nodes,
    "overview_edges": overview_edges,
    "entity_detail": part_detail,
    "citations_visible": visible_citations,
}

NODES = """
nodes AS (
  SELECT 'region:' || r_regionkey AS entity_id, r_name AS canonical_name, 'region' AS type_key, 'active' AS status, TIMESTAMP '2026-01-01' AS updated_at FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, n_name, 'nation', 'active', TIMESTAMP '2026-01-01' FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, c_name, 'customer', 'active', TIMESTAMP '2026-01-01' FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, s_name, 'supplier', 'active', TIMESTAMP '2026-01-01' FROM supplier
  UNION ALL SELECT 'part:' || p_partkey, p_name, 'part', 'active', TIMESTAMP '2026-01-01' FROM part
  UNION ALL SELECT 'orders:' || o_orderkey, 'order ' || o_orderkey, 'orders', CASE WHEN o_orderstatus = 'F' THEN 'merged' ELSE 'active' END, o_orderdate FROM orders)"""
EDGES = """
edges AS (
  SELECT 'customer:' || c_custkey AS source, 'located_in' AS relation, 'nation:' || c_nationkey AS target, 'c:' || c_custkey AS ev, true AS is_active FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'located_in', 'nation:' || s_nationkey, 's:' || s_suppkey, true FROM supplier
  UNION ALL SELECT 'nation:' || n_nationkey, 'part_of', 'region:' || n_regionkey, 'n:' || n_nationkey, true FROM nation
  UNION ALL SELECT 'customer:' || o_custkey, 'placed', 'orders:' || o_orderkey, 'o:' || o_orderkey, true FROM orders
  UNION ALL SELECT 'orders:' || l_orderkey, 'contains', 'part:' || l_partkey, 'l:' || l_orderkey || ':' || l_linenumber, l_returnflag <> 'R' FROM lineitem
  UNION ALL SELECT 'supplier:' || l_suppkey, 'supplies', 'part:' || l_partkey, 'l:' || l_orderkey || ':' || l_linenumber, l_returnflag <> 'R' FROM lineitem),
hop AS (
  SELECT source AS here, target AS there, relation, 'outgoing' AS direction, ev FROM edges WHERE is_active
  UNION ALL SELECT target, source, relation, 'incoming', ev FROM edges WHERE is_active)"""


def _traverse_sql(start: str, depth: int) -> str:
    return f"""WITH RECURSIVE {NODES}, {EDGES},
walk AS (
  SELECT there, relation, direction, 1 AS depth, ev, ['{start}', there] AS path FROM hop WHERE here = '{start}'
  UNION ALL SELECT h.there, h.relation, h.direction, w.depth + 1, h.ev, list_append(w.path, h.there)
  FROM (SELECT DISTINCT there, depth, path FROM walk) w JOIN hop h ON h.here = w.there WHERE w.depth < {depth} AND NOT list_contains(w.path, h.there))
SELECT n.entity_id, n.canonical_name, n.type_key, w.relation AS relation_key, w.direction, CAST(min(w.depth) AS INTEGER) AS depth, arg_min(w.ev, row(w.depth, w.ev)) AS evidence_id
FROM walk w JOIN nodes n ON n.entity_id = w.there WHERE n.status = 'active'
GROUP BY 1, 2, 3, 4, 5 ORDER BY depth, canonical_name, entity_id, relation_key, direction LIMIT 100"""


_PART = """
ev AS (SELECT 'l:' || l_orderkey || ':' || l_linenumber AS evidence_id, CAST(l_orderkey AS VARCHAR) AS note_id, 'line ' || l_linenumber AS content, l_shipdate AS at, l_partkey FROM lineitem WHERE l_linestatus = 'O'),
nt AS (SELECT CAST(o_orderkey AS VARCHAR) AS note_id, coalesce(nullif(o_orderpriority, '5-LOW'), 'Untitled meeting') AS note_title, 'https://orders.example/' || o_orderkey AS web_url FROM orders WHERE o_orderstatus <> 'P')"""

ORACLE = {
    "traverse_nation": _traverse_sql("nation:7", 2),
    "traverse_customer": _traverse_sql("customer:12", 3),
    "hop_degrees": f"WITH {EDGES} SELECT relation, direction, count(*) AS n FROM hop GROUP BY 1, 2",
    "relation_panel": f"WITH {NODES}, {EDGES} SELECT DISTINCT relation, direction, there AS other_id, coalesce(canonical_name, 'Unknown') AS other_name FROM hop LEFT JOIN nodes ON entity_id = there WHERE here = 'nation:7'",
    "overview_nodes": f"WITH {NODES}, c AS (SELECT entity_id AS id, canonical_name AS name, type_key AS type FROM nodes WHERE status = 'active' ORDER BY updated_at DESC, entity_id LIMIT 300) SELECT id, name, type, (SELECT count(*) >= 300 FROM c) AS truncated FROM c",
    "overview_edges": f"WITH {NODES}, {EDGES}, c AS (SELECT entity_id FROM nodes WHERE status = 'active' ORDER BY CASE WHEN type_key IN ('region', 'nation', 'supplier') THEN TIMESTAMP '2027-01-01' ELSE updated_at END DESC, entity_id LIMIT 300) SELECT source, relation, target, ev AS evidence_id FROM edges WHERE is_active AND source IN (SELECT * FROM c) AND target IN (SELECT * FROM c)",
    "entity_detail": f"""WITH {_PART},
f AS (SELECT p_partkey, unnest(['brand', 'type', 'size']) AS field_key, unnest(['{{"v":"' || p_brand || '"}}', '{{"v":"' || p_type || '"}}', '{{"v":' || p_size || '}}']) AS v FROM part WHERE p_partkey = 5)
SELECT 'part:5' AS entity_id, 'part' AS type_key, p_name AS canonical_name, p_name AS aliases, 'partkey=5' AS identifiers,
  coalesce((SELECT string_agg(f.field_key || '|' || f.v || '|' || ev.evidence_id || '|' || nt.note_title, ';' ORDER BY f.field_key, l.l_shipdate DESC, f.field_key || ':' || ev.evidence_id)
   FROM f JOIN lineitem l ON l.l_partkey = f.p_partkey JOIN ev ON ev.evidence_id = 'l:' || l.l_orderkey || ':' || l.l_linenumber JOIN nt USING (note_id)), '') AS properties FROM part WHERE p_partkey = 5""",
    "citations_visible": f"WITH {_PART} SELECT evidence_id, note_id, note_title, web_url, content AS excerpt FROM ev JOIN nt USING (note_id)",
}
