"""Queries over the note feed and the folder tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewarp.operators.due_notes import due_notes, newest_versions
from notewarp.operators.hierarchy import ancestor_pairs, folder_report, hierarchy, paths
from notewarp.operators.merkle import MerkleStore
from notewarp.session import cut, scratch, table


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """(note_id, version_us) of every note whose newest version still has to be processed."""
    return due_notes(table(spark, root, "note_feed"), table(spark, root, "processing_queue"))


def p1_runs(spark: SparkSession, root: str) -> DataFrame:
    """(note_id, change, version_us) of the second of two runs over the feed: the first saw what had arrived by the last complete pass."""
    feed = table(spark, root, "note_feed")
    done = table(spark, root, "sync_state").agg(F.max("last_completed_at").alias("done"))
    store = MerkleStore(spark, scratch(spark))
    early = feed.join(F.broadcast(done), F.col("received_at") <= F.col("done"), "left_semi")
    store.run(newest_versions(early), lambda pending: pending)
    store.run(newest_versions(feed), lambda pending: pending)
    return store.output().select(F.col("key").alias("note_id"), "change", F.col("digest").cast("long").alias("version_us"))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    """(folder_id, root_id, depth, n_below) of every folder."""
    return folder_report(table(spark, root, "folders"))


def p5_paths(spark: SparkSession, root: str) -> DataFrame:
    """(folder_id, path): ids from the root to the folder; null in and below loops."""
    nodes = cut(hierarchy(table(spark, root, "folders")))
    return paths(nodes, nodes.select("id", F.col("id").alias("name"))).withColumnRenamed("id", "folder_id")


def p5_descendants(spark: SparkSession, root: str) -> DataFrame:
    """(folder_id, below_id, levels): every folder below every folder outside loops."""
    nodes = cut(hierarchy(table(spark, root, "folders")))
    pairs = ancestor_pairs(nodes).join(nodes.select("id", "depth"), "id")
    return pairs.select(F.col("ancestor").alias("folder_id"), F.col("id").alias("below_id"), (F.col("depth") - F.col("ancestor_depth")).cast("long").alias("levels"))


QUERIES = {"p1_found": p1_found, "p1_runs": p1_runs, "p5_found": p5_found, "p5_paths": p5_paths, "p5_descendants": p5_descendants}

_FOLDERS = r"""
WITH RECURSIVE f AS (SELECT trim(id) AS id, min(nullif(trim(parent_folder_id), '')) AS p FROM folders WHERE trim(id) <> '' GROUP BY 1),
g AS (SELECT id, CASE WHEN p IN (SELECT id FROM f) THEN p END AS p FROM f),
r AS (SELECT id, id AS root, 0 AS d, id AS path FROM g WHERE p IS NULL
      UNION ALL SELECT g.id, r.root, r.d + 1, r.path || '/' || g.id FROM g JOIN r ON g.p = r.id),
a AS (SELECT id, p AS a, 1 AS levels FROM g WHERE p IS NOT NULL AND id IN (SELECT id FROM r)
      UNION ALL SELECT a.id, g.p, a.levels + 1 FROM a JOIN g ON g.id = a.a WHERE g.p IS NOT NULL)
"""

ORACLE = {
    "p1_found": """
WITH n AS (SELECT id, max(updated_at) AS v FROM note_feed GROUP BY 1),
l AS (SELECT note_id, arg_max(state, queue_seq) AS st, arg_max(force_reprocess, queue_seq) AS forced FROM processing_queue GROUP BY 1)
SELECT n.id AS note_id, epoch_us(v) AS version_us FROM n LEFT JOIN l ON l.note_id = n.id
WHERE (NOT EXISTS (SELECT 1 FROM processing_queue q WHERE q.note_id = n.id AND q.state = 'complete' AND q.remote_updated_at >= v)
   AND NOT EXISTS (SELECT 1 FROM processing_queue q WHERE q.note_id = n.id AND q.remote_updated_at = v AND q.attempts >= 5))
   OR (st = 'pending' AND forced)""",
    "p1_runs": """
WITH n AS (SELECT id, max(updated_at) AS v, max(updated_at) FILTER (WHERE received_at <= (SELECT max(last_completed_at) FROM sync_state)) AS w FROM note_feed GROUP BY 1)
SELECT id AS note_id, CASE WHEN w IS NULL THEN 'added' ELSE 'changed' END AS change, epoch_us(v) AS version_us FROM n WHERE w IS NULL OR w <> v""",
    "p5_found": _FOLDERS
    + """, b AS (SELECT a, count(*) AS n FROM a GROUP BY 1)
SELECT g.id AS folder_id, coalesce(r.root, 'cycle') AS root_id, CAST(coalesce(r.d, -1) AS BIGINT) AS depth,
       CAST(CASE WHEN r.root IS NULL THEN -1 ELSE coalesce(b.n, 0) END AS BIGINT) AS n_below
FROM g LEFT JOIN r ON r.id = g.id LEFT JOIN b ON b.a = g.id""",
    "p5_paths": _FOLDERS + "SELECT g.id AS folder_id, r.path FROM g LEFT JOIN r ON r.id = g.id",
    "p5_descendants": _FOLDERS + "SELECT a AS folder_id, id AS below_id, CAST(levels AS BIGINT) AS levels FROM a",
}
