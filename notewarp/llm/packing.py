"""Filling fixed-capacity containers with items: vector bin packing by the dot-product heuristic.

An item has a size in three dimensions: tokens, segments (one per item) and loss-bearing tokens. A container limits all three. The
open container takes, of the items that fit in every dimension, the one whose size has the greatest dot product with what is left of
it, both scaled by the limits; when nothing fits, the next container is opened. Items are spread over shards of about SHARD_ITEMS by a
hash, and each shard is packed by itself: a task holds one shard's sizes, never texts.

An item is only cut when it exceeds a container alone: into pieces of the container's size and a remainder.

Defined results: null ids, null and empty texts are no items; repeated rows are items of their own; ties go to the smaller id; a kind
of container that isn't in size_limits gives no rows; empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewarp.llm.tokens import RANKS, token_counts
from notewarp.session import cut_counted

#: Items packed together in one task, about.
SHARD_ITEMS = 3000
#: Segments allowed in one container.
MAX_SEGMENTS = 64
#: Loss-bearing tokens allowed, as a share of a container's tokens.
LOSS_SHARE = 1.0

PACKED = "item_kind string, container_id string, doc_id long, piece int, token_start long, n_tokens long, loss_tokens long"


def pack(sizes: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Container number of each item; `sizes` is items x dimensions, every item fits alone, `limits` is per dimension."""
    n = len(sizes)
    scaled = sizes / limits
    order = np.argsort(-sizes[:, 0], kind="stable")
    ours, exact = scaled[order], sizes[order]
    result = np.full(n, -1, dtype=np.int64)
    bin_no = -1
    while len(order):
        bin_no += 1
        room, left = limits.astype(np.float64).copy(), np.ones(sizes.shape[1])
        while len(order):
            # sorted by tokens: what is too long is a prefix
            start = int(np.searchsorted(-exact[:, 0], -room[0], side="left"))
            if start >= len(order):
                break
            fits = (exact[start:] <= room).all(axis=1)
            if not fits.any():
                break
            score = np.where(fits, ours[start:] @ left, -1.0)
            at = start + int(score.argmax())
            result[order[at]] = bin_no
            room -= exact[at]
            left = room / limits
            order, ours, exact = np.delete(order, at), np.delete(ours, at, axis=0), np.delete(exact, at, axis=0)
    return result


def _pack_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True]).reset_index(drop=True)
    first = pdf.iloc[0]
    limits = np.array([first["max_tokens"], first["max_segments"], first["max_loss"]], dtype=np.float64)
    sizes = np.column_stack([pdf["n_tokens"], np.ones(len(pdf)), pdf["loss_tokens"]]).astype(np.float64)
    bins = pack(sizes, limits)
    out = pdf[["item_kind", "doc_id", "piece", "token_start", "n_tokens", "loss_tokens"]].copy()
    out.insert(1, "container_id", [f"{first['item_kind']}-{first['shard']}-{b}" for b in bins])
    return out


def pieces(counts: DataFrame, limits: DataFrame, *, kinds: tuple[str, ...], max_segments: int = MAX_SEGMENTS, loss_share: float = LOSS_SHARE) -> DataFrame:
    """One row per item of each kind of container; longer ones cut into rows that fit alone."""
    sizes = limits.filter(F.col("item_kind").isin(*kinds)).groupBy("item_kind").agg(F.max("max_size").alias("max_size"))
    # a parameter table: at most a row per kind
    asked = [(r.item_kind, int(r.max_size)) for r in sizes.orderBy("item_kind").collect() if r.max_size and r.max_size > 0]
    fields = "item_kind", "max_tokens", "max_segments", "max_loss"
    each = [F.struct(*[F.lit(v).cast(t).alias(f) for f, v, t in zip(fields, (kind, size, max_segments, max(1, int(size * loss_share))), ("string", "long", "long", "long"))]) for kind, size in asked]
    of = F.explode(F.array(*each) if each else F.array().cast("array<struct<item_kind:string,max_tokens:bigint,max_segments:bigint,max_loss:bigint>>"))
    items = counts.select("*", of.alias("kind")).select(*counts.columns, "kind.*")
    loss = F.col("n_tokens") - F.col("prompt_tokens")
    fits = (F.col("n_tokens") <= F.col("max_tokens")) & (loss <= F.col("max_loss"))
    step = F.when(fits, F.greatest("n_tokens", F.lit(1))).otherwise(F.least("max_tokens", "max_loss"))
    cut_up = items.withColumn("step", step).withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.expr("cast((n_tokens - 1) div step as int)")))))
    start = F.col("piece") * F.col("step")
    end = F.least(start + F.col("step"), F.col("n_tokens"))
    return cut_up.select(
        "item_kind", "doc_id", "piece", start.alias("token_start"), (end - start).alias("n_tokens"), F.greatest(F.lit(0), end - F.greatest(start, F.col("prompt_tokens"))).alias("loss_tokens"), "max_tokens", "max_segments", "max_loss"
    )


def containers(documents: DataFrame, limits: DataFrame, *, kinds: tuple[str, ...] = ("container", "container_small"), ranks: str = RANKS, max_segments: int = MAX_SEGMENTS, loss_share: float = LOSS_SHARE) -> DataFrame:
    """(item_kind, container_id, doc_id, piece, token_start, n_tokens, loss_tokens): where every item goes, per kind of container."""
    rows, n = cut_counted(pieces(token_counts(documents, ranks=ranks), limits, kinds=kinds, max_segments=max_segments, loss_share=loss_share))
    full = rows.filter("n_tokens = max_tokens").select("item_kind", F.concat_ws("-", "item_kind", F.lit("full"), "doc_id", "piece").alias("container_id"), "doc_id", "piece", "token_start", "n_tokens", "loss_tokens")
    shards = max(1, -(-n // (SHARD_ITEMS * len(kinds))))
    rest = rows.filter("n_tokens < max_tokens").withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)))
    return full.unionByName(rest.groupBy("item_kind", "shard").applyInPandas(_pack_shard, PACKED))


def fill_report(packed: DataFrame, limits: DataFrame) -> DataFrame:
    """(item_kind, containers, items, tokens, fill): how full the containers of each kind are."""
    sizes = limits.groupBy("item_kind").agg(F.max("max_size").alias("max_tokens"))
    # containers first, so that the second aggregation is over one row each
    each = packed.groupBy("item_kind", "container_id").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("items"))
    total = each.groupBy("item_kind").agg(F.count("*").alias("containers"), F.sum("items").alias("items"), F.sum("tokens").alias("tokens"))
    return total.join(sizes, "item_kind").select("item_kind", "containers", "items", "tokens", (F.col("tokens") / (F.col("containers") * F.col("max_tokens"))).alias("fill"))


def use_report(packed: DataFrame, limits: DataFrame, *, max_segments: int = MAX_SEGMENTS, loss_share: float = LOSS_SHARE, near: float = 0.98) -> DataFrame:
    """Per kind of container and dimension: mean use, greatest use, and containers that are full in it (from `near` of its limit on)."""
    sizes = limits.groupBy("item_kind").agg(F.max("max_size").alias("m"))
    each = packed.groupBy("item_kind", "container_id").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("s"), F.sum("loss_tokens").alias("l")).join(F.broadcast(sizes), "item_kind")
    # what sizes holds is a parameter table of a few rows
    share = {"tokens": F.col("t") / F.col("m"), "segments": F.col("s") / F.lit(max_segments), "loss": F.col("l") / F.greatest(F.lit(1), F.floor(F.col("m") * loss_share))}
    used = each.select("item_kind", *[v.alias(k) for k, v in share.items()])
    return used.groupBy("item_kind").agg(
        F.count("*").alias("containers"),
        *[F.avg(k).alias(f"{k}_use") for k in share],
        *[F.max(k).alias(f"most_{k}") for k in share],
        *[F.count_if(F.col(k) >= near).alias(f"at_{k}") for k in share],
    )
