"""Full hierarchies from parent-child links: root, depth, path, descendants, loops.

1. Leaves are peeled off round by round; what can't be peeled is loops and whatever long chains were left when peeling slowed
   down. Pointer doubling over that core tells the two apart, so that a deep chain costs log(depth) rounds, not depth.
2. Each loop node is cut from its parent and becomes a marked root: every node now lies in one tree.
3. Each tree becomes an Euler tour: a list of one entry and one exit element per node. The order of siblings doesn't matter to
   the results, so siblings are chained in salted groups, and the groups of a parent are chained to each other.
4. Parallel list ranking (pointer doubling) gives each element its distance to the end of its list in entries and in levels.
   Entry and exit ranks then give the depth, the number of nodes below and the interval that contains all of them.

Defined results: ids are compared without surrounding white space; rows with a null or blank id are ignored; repeated rows of an id
are one node, whose parent is the smallest usable one if they disagree; a blank or unknown parent makes a root; nodes in a loop or
below one have `in_cycle` true. Empty tables give empty results. Extra columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from notewarp.session import cut, cut_counted, drop

#: Rounds of doubling are bounded by the bits of a row count.
MAX_ROUNDS = 64
#: Peeling goes on while a round takes off at least one in so many of the remaining nodes.
PEEL_SHARE = 3
#: Siblings in one chained group, about.
GROUP_SIBLINGS = 50_000
_WHITE = r"^[\s ]+|[\s ]+$"


def _trimmed(name: str) -> Column:
    return F.nullif(F.regexp_replace(F.col(name), _WHITE, ""), F.lit(""))


def clean_links(links: DataFrame, id_col: str, parent_col: str) -> DataFrame:
    """(id, parent) with one row per id; parent is null at a root."""
    raw = links.select(_trimmed(id_col).alias("id"), _trimmed(parent_col).alias("parent")).filter("id is not null")
    known = raw.groupBy("id").agg(F.lit(1).alias("known"))
    parents = raw.filter("parent is not null").distinct()
    usable = parents.join(known.select(F.col("id").alias("parent")), "parent", "left_semi").groupBy("id").agg(F.min("parent").alias("parent"))
    return known.select("id").join(usable, "id", "left")


def _jumped(pointers: DataFrame) -> DataFrame:
    """(id, to) with every pointer followed once more; pointers that lead outside are gone."""
    step = pointers.select(F.col("id").alias("to"), F.col("to").alias("next"))
    return pointers.join(step, "to").select("id", F.col("next").alias("to"))


def loop_nodes(nodes: DataFrame) -> DataFrame:
    """Ids that lie on a loop."""
    core, left = cut_counted(nodes.filter("parent is not null"))
    while left:
        inner, now = cut_counted(core.join(core.select(F.col("parent").alias("id")).distinct(), "id", "left_semi"))
        drop(core)
        core, taken, left = inner, left - now, now
        if taken * PEEL_SHARE < left + taken:
            break
    if not left:
        return core.select("id")
    # pointers out of the core belong to chains; once a round loses none, only loops and what hangs below them is left.
    # The tails below loops go the same way: once the set of nodes that pointers reach stops shrinking, a jump permutes it.
    jump, caught = cut_counted(core.select("id", F.col("parent").alias("to")))
    reached = -1
    for _ in range(MAX_ROUNDS):
        further, now = cut_counted(_jumped(jump))
        drop(jump)
        jump, stable, caught = further, now == caught, now
        if stable:
            image, now = cut_counted(jump.select(F.col("to").alias("id")).distinct())
            if now == reached:
                return image
            reached = now
    raise AssertionError("more rounds than a row count has bits")


def _chained(nodes: DataFrame) -> DataFrame:
    """(id, parent, next sibling, first and last flags): siblings chained in salted groups."""
    sizes = nodes.filter("parent is not null").groupBy("parent").agg(F.count("*").alias("n"))
    salted = nodes.filter("parent is not null").join(sizes, "parent")
    groups = F.greatest(F.lit(1), F.ceil(F.col("n") / GROUP_SIBLINGS))
    salted = salted.withColumn("g", F.pmod(F.xxhash64("id"), groups)).drop("n")
    inside = W.partitionBy("parent", "g").orderBy("id")
    linked = salted.withColumn("after", F.lead("id").over(inside)).withColumn("before", F.lag("id").over(inside))
    heads = linked.filter("before is null").select("parent", "g", F.col("id").alias("head"))
    across = W.partitionBy("parent").orderBy("g")
    heads = heads.withColumn("next_head", F.lead("head").over(across)).withColumn("first_group", F.lag("head").over(across).isNull())
    joined = linked.join(heads.select("parent", "g", "next_head", "first_group"), ["parent", "g"])
    return joined.select(
        "id",
        "parent",
        F.coalesce("after", "next_head").alias("sibling"),
        (F.col("before").isNull() & F.col("first_group")).alias("is_first"),
    )


def euler_tour(nodes: DataFrame) -> DataFrame:
    """List elements (node, is_exit, next_node, next_is_exit) of all trees of (id, parent); next_node is null at a list's end."""
    chained = cut(_chained(nodes))
    first = chained.filter("is_first").select(F.col("parent").alias("id"), F.col("id").alias("child"))
    enter = nodes.select("id").join(first, "id", "left").select(
        F.col("id").alias("node"), F.lit(False).alias("is_exit"), F.coalesce("child", "id").alias("next_node"), F.col("child").isNull().alias("next_is_exit")
    )
    leave = nodes.select("id").join(chained.select("id", "parent", "sibling"), "id", "left").select(
        F.col("id").alias("node"), F.lit(True).alias("is_exit"), F.coalesce("sibling", "parent").alias("next_node"), F.col("sibling").isNull().alias("next_is_exit")
    )
    return enter.unionByName(leave)


def _ranked_further(ranked: DataFrame) -> DataFrame:
    """Every element's pointer followed once more, with the sums on the way; elements at the end of their list stay."""
    ahead = ranked.select(F.col("at").alias("to"), F.col("to").alias("to2"), F.col("entries").alias("e2"), F.col("levels").alias("l2"), F.col("last").alias("last2"))
    done = F.col("to").isNull()
    return ranked.join(ahead, "to", "left").select(
        "at",
        F.col("to2").alias("to"),
        (F.col("entries") + F.coalesce("e2", F.lit(0))).alias("entries"),
        (F.col("levels") + F.coalesce("l2", F.lit(0))).alias("levels"),
        F.when(done, F.col("last")).otherwise(F.col("last2")).alias("last"),
    )


def rank_list(tour: DataFrame, n_nodes: int) -> DataFrame:
    """(node, is_exit, entries, levels, last): sums over the rest of the list, the element itself included, and the list's last node.

    Two jumps a round; `n_nodes` bounds the length of a list and so the number of rounds.
    """
    key = F.struct("node", "is_exit")
    ranked = cut(
        tour.select(
            key.alias("at"),
            F.when(F.col("next_node").isNotNull(), F.struct(F.col("next_node").alias("node"), F.col("next_is_exit").alias("is_exit"))).alias("to"),
            F.when(F.col("is_exit"), 0).otherwise(1).cast("long").alias("entries"),
            F.when(F.col("is_exit"), -1).otherwise(1).cast("long").alias("levels"),
        )
        .withColumn("last", F.when(F.col("to").isNull(), F.col("at.node")))
    )
    for _ in range(math.ceil(math.log(2 * max(n_nodes, 1) + 1, 4)) + 1):
        further = cut(_ranked_further(_ranked_further(ranked)))
        drop(ranked)
        ranked = further
    return ranked.select("at.node", "at.is_exit", "entries", "levels", "last")


def hierarchy(links: DataFrame, *, id_col: str = "id", parent_col: str = "parent_folder_id") -> DataFrame:
    """(id, parent, root, depth, n_below, enter, leave, in_cycle), one row per node.

    All nodes below u, and no others, have u.root and an `enter` in the interval (u.enter, u.leave]. For nodes in or below a loop
    `root` is the loop node they hang from, and depth and n_below count within the cut tree.
    """
    nodes, n_nodes = cut_counted(clean_links(links, id_col, parent_col))
    loops = loop_nodes(nodes).withColumn("on_loop", F.lit(True))
    forest = cut(nodes.join(loops, "id", "left").select("id", F.col("parent").alias("link"), F.when(F.col("on_loop").isNull(), F.col("parent")).alias("parent"), F.coalesce("on_loop", F.lit(False)).alias("on_loop")))
    ranked = rank_list(euler_tour(forest.select("id", "parent")), n_nodes)
    per_node = ranked.groupBy("node").agg(
        F.max(F.when(~F.col("is_exit"), F.col("entries"))).alias("from_enter"),
        F.max(F.when(F.col("is_exit"), F.col("entries"))).alias("from_exit"),
        F.max(F.when(F.col("is_exit"), F.col("levels"))).alias("exit_levels"),
        F.max("last").alias("root"),
    )
    # the exits from a node up to its root are depth + 1 more than the entries in between
    placed = per_node.select(
        F.col("node").alias("id"),
        "root",
        (-F.col("exit_levels") - 1).alias("depth"),
        (F.col("from_enter") - F.col("from_exit") - 1).alias("n_below"),
        "from_enter",
    )
    roots = placed.filter("id = root").select("root", F.col("n_below").alias("tree_below"))
    cyclic_roots = forest.filter("on_loop").select(F.col("id").alias("root"), F.lit(True).alias("in_cycle"))
    return (
        placed.join(roots.join(cyclic_roots, "root", "left"), "root")
        .join(forest.select("id", F.col("link").alias("parent")), "id")
        .select(
            "id",
            "parent",
            "root",
            "depth",
            "n_below",
            (F.col("tree_below") + 1 - F.col("from_enter")).alias("enter"),
            (F.col("tree_below") + 1 - F.col("from_enter") + F.col("n_below")).alias("leave"),
            F.coalesce("in_cycle", F.lit(False)).alias("in_cycle"),
        )
    )


def ancestor_pairs(nodes: DataFrame) -> DataFrame:
    """(root, ancestor, ancestor_depth, id) for every node and each of its proper ancestors, from the intervals alone.

    `nodes` is a result of `hierarchy`; nodes of loops are left out. An interval is covered by the aligned blocks of a binary
    partition of the entry numbers, a node belongs to one block per level: the containment becomes an equi-join on (root, level, block)
    that makes no pair that is not a result.
    """
    spans = nodes.filter("not in_cycle and n_below > 0").select("root", F.col("id").alias("ancestor"), F.col("depth").alias("ancestor_depth"), (F.col("enter") + 1).alias("lo"), (F.col("leave") + 1).alias("hi"))
    # blocks [k 2^l, (k+1) 2^l) of the half-open span: at each level at most one on the left and one on the right
    level = F.explode(F.sequence(F.lit(0), F.lit(40))).alias("level")
    step = spans.select("*", level).withColumn("lo_l", F.expr("(lo + shiftleft(1L, level) - 1) div shiftleft(1L, level)")).withColumn("hi_l", F.expr("hi div shiftleft(1L, level)"))
    step = step.filter("lo_l < hi_l")
    left = step.filter("lo_l % 2 = 1").select("root", "ancestor", "ancestor_depth", "level", F.col("lo_l").alias("block"))
    # a right block is only taken where the left one hasn't already used it up
    right = step.filter("hi_l % 2 = 1 and not (lo_l % 2 = 1 and lo_l = hi_l - 1)").select("root", "ancestor", "ancestor_depth", "level", (F.col("hi_l") - 1).alias("block"))
    cover = left.unionByName(right)
    levels = cover.select("root", "level").distinct()
    points = nodes.filter("not in_cycle and depth > 0").join(levels, "root").select("root", "id", "level", F.expr("enter div shiftleft(1L, level)").alias("block"))
    return points.join(cover, ["root", "level", "block"]).select("root", "ancestor", "ancestor_depth", "id")


def paths(nodes: DataFrame, names: DataFrame, *, separator: str = "/") -> DataFrame:
    """(id, path): names from the root down, joined. `names` is (id, name), one row per id; nodes of loops have a null path."""
    pairs = ancestor_pairs(nodes).select("id", F.col("ancestor").alias("of"), F.col("ancestor_depth").alias("at"))
    own = nodes.filter("not in_cycle").select("id", F.col("id").alias("of"), F.col("depth").alias("at"))
    steps = pairs.unionByName(own).join(names.select(F.col("id").alias("of"), F.coalesce("name", F.lit("")).alias("name")), "of", "left")
    built = steps.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda s: F.coalesce(s["name"], F.lit(""))), separator).alias("path"))
    return nodes.select("id").join(built, "id", "left")


def folder_report(folders: DataFrame) -> DataFrame:
    """(folder_id, root_id, depth, n_below): `cycle` and -1 for folders in a loop or below one."""
    placed = hierarchy(folders)
    caught = F.col("in_cycle")
    return placed.select(
        F.col("id").alias("folder_id"),
        F.when(caught, "cycle").otherwise(F.col("root")).alias("root_id"),
        F.when(caught, -1).otherwise(F.col("depth")).cast("long").alias("depth"),
        F.when(caught, -1).otherwise(F.col("n_below")).cast("long").alias("n_below"),
    )
