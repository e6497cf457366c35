"""Processing only what changed: a Merkle tree over key-range hashes.

A record is (key, digest). Keys are spread over 2^64 by a hash; a leaf covers one range of that space, an inner node
FANOUT neighbouring ranges. A node's digest is the wrapping sum of mixed record digests, so it is built by one
map-side-combined aggregation and does not depend on order.

`MerkleStore` keeps a version per successful run below one folder: `output`, `records` (in folders by key range, sorted by leaf) and
`tree` (all levels). A run builds the tree of the current records at the saved depth and goes down from the root, level by level, only
below nodes whose saved and current digests differ; of the saved records it reads only the folders and leaves that differ. Each attempt
writes to a folder of its own, key ranges without a change keep pointing to the former version's folder, and one rename of a manifest
puts output, records and tree in force together. A run that dies before that rename leaves the former version as it was, so the next
run sees the same changes again; a run that lost the race to another one raises, and what the other published stays.

Defined results: rows with a null key are ignored; a null digest is a value like any other; repeated rows of one key collapse to
the greatest digest; an empty side makes every key of the other side a change.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notewarp.operators.snapshot import Manifests
from notewarp.session import cut, cut_counted

#: Children of an inner node.
FANOUT = 16
#: Records aimed at in a leaf.
LEAF_RECORDS = 32
#: Levels of nodes that have a folder of their own, at most (FANOUT ** 3 folders), and levels of leaves inside a folder.
FOLDER_LEVELS, LEVELS_IN_FOLDER = 3, 2

RECORDS = "key string, digest string, leaf long"
TREE = "level int, node long, digest decimal(38,0), n long"


def depth_for(records: int, *, leaf_records: int = LEAF_RECORDS) -> int:
    """Levels below the root so that a leaf holds about `leaf_records`; at least 1."""
    return max(1, math.ceil(math.log(max(records / leaf_records, 1.0), FANOUT)))


def folder_level(depth: int) -> int:
    """Level of the tree whose nodes have a folder each."""
    return min(FOLDER_LEVELS, max(0, depth - LEVELS_IN_FOLDER))


def range_of(key: Column, depth: int) -> Column:
    """Number of the key's leaf among FANOUT**depth equal ranges of the hashed key space."""
    return F.shiftrightunsigned(F.xxhash64(key), 64 - 4 * depth)


def above(node: Column | str, levels: int) -> Column:
    """The node's ancestor so many levels up."""
    return F.shiftrightunsigned(node, 4 * levels)


def mixed(key: Column, digest: Column) -> Column:
    """64-bit hash of one record; a null digest counts."""
    return F.xxhash64(key, F.coalesce(digest, F.lit("\u0000null")))


def collapsed(records: DataFrame) -> DataFrame:
    """(key, digest), a row per key."""
    return records.filter("key is not null").groupBy("key").agg(F.max(F.coalesce("digest", F.lit(""))).alias("digest"))


def tree_of(leafed: DataFrame, depth: int) -> DataFrame:
    """(level, node, digest, n): all levels of the tree over records (key, digest, leaf), root at level 0."""
    # sums of decimals can't overflow below 10^18 records; the digest is compared, never decoded
    level = cut(leafed.groupBy(F.col("leaf").alias("node")).agg(F.sum(mixed(F.col("key"), F.col("digest")).cast("decimal(20,0)")).cast("decimal(38,0)").alias("digest"), F.count("*").alias("n")))
    levels = level.select(F.lit(depth).alias("level"), "node", "digest", "n")
    for up in range(1, depth + 1):
        folded = level.groupBy(above("node", up).alias("node")).agg(F.sum("digest").cast("decimal(38,0)").alias("digest"), F.sum("n").alias("n"))
        levels = levels.unionByName(folded.select(F.lit(depth - up).alias("level"), "node", "digest", "n"))
    return levels


def differing_leaves(current: DataFrame, saved: DataFrame, depth: int) -> DataFrame:
    """(leaf): leaves whose digests differ between two trees, found from the root down through differing nodes only."""
    open_nodes = None
    for level in range(depth + 1):
        sides = []
        for tree, name in ((current, "now"), (saved, "old")):
            nodes = tree.filter(F.col("level") == level).select("node", F.struct("digest", "n").alias(name))
            if open_nodes is not None:
                nodes = nodes.withColumn("up", above("node", 1)).join(open_nodes.withColumnRenamed("node", "up"), "up", "left_semi").drop("up")
            sides.append(nodes)
        open_nodes = sides[0].join(sides[1], "node", "full_outer").filter(~F.col("now").eqNullSafe(F.col("old"))).select("node")
    return open_nodes.withColumnRenamed("node", "leaf")


@dataclass
class Comparison:
    """What a run has found out before it processes anything."""

    version: int
    depth: int
    now: DataFrame  # key, digest, leaf
    count: int
    tree: DataFrame
    leaves: DataFrame | None  # leaf; None: there is nothing saved, everything is new
    n_leaves: int
    folders: list[int]


class MerkleStore:
    """Durable state of incremental runs below `path` (any Hadoop file system)."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._manifests = Manifests(spark, self.path)

    def version(self) -> int:
        """Number of the version in force; 0 before the first run."""
        return self._manifests.newest()

    def saved(self, folders: list[int] | None = None) -> DataFrame:
        """(key, digest, leaf) of the version in force, of the given folders only; a folder is a range of leaves."""
        held = self._manifests.read().get("records", {})
        paths = [f"{self.path}/{p}" for f, p in sorted(held.items()) if folders is None or int(f) in folders]
        return self.spark.read.schema(RECORDS).parquet(*paths) if paths else self.spark.createDataFrame([], RECORDS)

    def saved_tree(self) -> DataFrame:
        """All levels of the tree of the version in force."""
        return self.spark.read.schema(TREE).parquet(f"{self.path}/{self._manifests.read()['tree']}")

    def output(self) -> DataFrame:
        """The output that was published last."""
        return self.spark.read.parquet(f"{self.path}/{self._manifests.read()['output']}")

    def compare(self, records: DataFrame) -> Comparison:
        """Build the current tree and go down both trees; the depth is the saved one."""
        manifest = self._manifests.read()
        if not manifest:
            rows, count = cut_counted(collapsed(records))
            depth = depth_for(count)
            now = rows.withColumn("leaf", range_of(F.col("key"), depth))
            return Comparison(0, depth, now, count, cut(tree_of(now, depth)), None, 0, [])
        depth = manifest["depth"]
        now, count = cut_counted(collapsed(records).withColumn("leaf", range_of(F.col("key"), depth)))
        tree = cut(tree_of(now, depth))
        leaves, n = cut_counted(differing_leaves(tree, self.saved_tree(), depth))
        # at most FANOUT ** FOLDER_LEVELS numbers
        folders = [r[0] for r in leaves.select(above("leaf", depth - folder_level(depth))).distinct().collect()]
        return Comparison(manifest["version"], depth, now, count, tree, leaves, n, sorted(folders))

    def pending(self, records: DataFrame | Comparison) -> DataFrame:
        """Keys that are new, changed or gone: (key, digest, saved_digest, change). Only leaves that differ are read."""
        c = records if isinstance(records, Comparison) else self.compare(records)
        if c.leaves is None:
            return c.now.select("key", "digest", F.lit(None).cast("string").alias("saved_digest"), F.lit("added").alias("change"))
        inside = above("leaf", c.depth - folder_level(c.depth)).isin(c.folders) if c.folders else F.lit(False)
        now = c.now.filter(inside).join(c.leaves, "leaf", "left_semi").select("key", "digest")
        old = self.saved(c.folders).join(c.leaves, "leaf", "left_semi").select("key", F.col("digest").alias("saved_digest"))
        both = now.join(old, "key", "full_outer").filter(~F.col("digest").eqNullSafe(F.col("saved_digest")))
        kind = F.when(F.col("saved_digest").isNull(), "added").when(F.col("digest").isNull(), "removed").otherwise("changed")
        return both.select("key", "digest", "saved_digest", kind.alias("change"))

    def publish(self, records: DataFrame | Comparison, output: DataFrame, *, expected: int | None = None) -> int:
        """Write output, changed records and tree, and put them in force by one rename.

        `expected` is the version the output was computed from; if another run has published since, this one raises and changes nothing.
        """
        c = records if isinstance(records, Comparison) else self.compare(records)
        if expected is not None and c.version != expected:
            raise RuntimeError(f"version {c.version} is in force, the output was computed from {expected}")
        attempt = f"v{c.version + 1}-{uuid.uuid4().hex}"
        depth, now, tree, held = c.depth, c.now, c.tree, dict(self._manifests.read().get("records", {}))
        changed = c.leaves is None or c.n_leaves > 0
        if c.leaves is not None and depth_for(c.count) != depth:
            # the records have outgrown the tree: all ranges are written anew at the new depth
            depth = depth_for(c.count)
            now = now.withColumn("leaf", range_of(F.col("key"), depth))
            tree, held, changed = tree_of(now, depth), {}, True
        elif c.leaves is not None:
            now = now.filter(above("leaf", depth - folder_level(depth)).isin(c.folders)) if c.folders else now.limit(0)
            held = {f: p for f, p in held.items() if int(f) not in c.folders}
        output.write.parquet(f"{self.path}/{attempt}/output")
        if changed:
            rows = now.withColumn("folder", above("leaf", depth - folder_level(depth)))
            rows.repartition("folder").sortWithinPartitions("folder", "leaf").write.partitionBy("folder").parquet(f"{self.path}/{attempt}/records")
            held |= {str(f): f"{attempt}/records/folder={f}" for f in self._manifests.numbers(f"{attempt}/records", "folder=")}
            tree.repartition(F.col("level")).sortWithinPartitions("level", "node").write.parquet(f"{self.path}/{attempt}/tree")
        where = f"{attempt}/tree" if changed else self._manifests.read()["tree"]
        self._manifests.publish(c.version + 1, {"depth": depth, "records": held, "tree": where, "output": f"{attempt}/output"})
        return c.version + 1

    def run(self, records: DataFrame, process) -> int:
        """One run: `process` gets the pending keys and returns the output to publish with the new tree."""
        c = self.compare(records)
        return self.publish(c, process(self.pending(c)), expected=c.version)
