"""Mixing sources to target weights: capped water-filling over tokens, whole and fractional repetitions of documents.

Each source has a target share and a bound on repetitions. For a mixture of T tokens a source is asked for share * T; sources that
can't give that within their repetitions are clamped at their maximum, and what is missing goes to the others in proportion to their
shares, until nobody is asked for more than it has. Of a source asked for e epochs every document comes floor(e) times, and once more
those whose seeded hash lies below the value up to which the source's documents have the remaining tokens.

T is a parameter. By default it is all tokens that the sources with a place have: scarce sources are clamped and the report shows the
shares that are reached. With `full=False` T is the greatest size at which no source with documents has to be clamped, so that shares are
exact and the scarcest source sets the size. Absent sources' shares are spread over the others.

Defined results: sources compare without case, and with white space, `-` and `_` alike; documents of other or null sources, with null ids
or without text take no part; null, negative or repeated weights: null and negative count as 0, repeated rows of a source are added;
max_repeats below 1 or null gives the source no place; repeated rows of a document are documents of their own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from notewarp.llm.tokens import RANKS, token_counts
from notewarp.session import cut

#: Cells of the hash range in which a source's tokens are summed to find where its last epoch ends.
CELLS = 4096


def source_key(col: Column) -> Column:
    """A source's name without case; runs of white space, `-` and `_` are one `_`."""
    return F.regexp_replace(F.lower(F.trim(col)), r"(?U)[\s_-]+", "_")


@dataclass(frozen=True)
class Share:
    """One source of a mixture."""

    source: str
    target: float
    cap: int
    tokens: int
    asked: float = 0.0

    @property
    def most(self) -> float:
        return float(self.tokens * self.cap)


def water_fill(sources: list[Share], total: float) -> dict[str, float]:
    """Tokens asked of each source for a mixture of `total` tokens (less, if all together can't give that)."""
    asked = {s.source: 0.0 for s in sources}
    free = [s for s in sources if s.target > 0 and s.most > 0]
    left = total
    while free:
        weight = sum(s.target for s in free)
        over = [s for s in free if left * s.target / weight >= s.most]
        if not over:
            for s in free:
                asked[s.source] = left * s.target / weight
            break
        for s in over:
            asked[s.source] = s.most
            left -= s.most
        free = [s for s in free if s not in over]
    return asked


def exact_total(sources: list[Share]) -> float:
    """The greatest total at which no source that has documents is clamped."""
    present = [s for s in sources if s.target > 0 and s.most > 0]
    weight = sum(s.target for s in present)
    return min((s.most * weight / s.target for s in present), default=0.0)


def all_tokens_total(sources: list[Share]) -> float:
    """The tokens of all sources that have a place in the mixture."""
    return float(sum(s.tokens for s in sources if s.target > 0 and s.most > 0))


def mixture(documents: DataFrame, weights: DataFrame, *, total_tokens: float | None = None, full: bool = True, seed: int = 17, ranks: str = RANKS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, repeats, n_tokens) of the mixture, and (source, target_share, max_repeats, available_tokens, tokens, actual_share, epochs)."""
    spark = documents.sparkSession
    table = weights.filter("source is not null").groupBy(source_key(F.col("source")).alias("source"))
    # the weights are a parameter table: one row per source
    wanted = {r.source: (r.target, r.cap) for r in table.agg(F.sum(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))).alias("target"), F.max(F.coalesce("max_repeats", F.lit(0))).alias("cap")).collect()}
    docs = documents.withColumn("source", source_key(F.col("source"))).filter(F.col("source").isin(*wanted) if wanted else F.lit(False))
    place = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(CELLS * 1024)).cast("int")
    counts = cut(token_counts(docs, ranks=ranks).withColumn("place", place))
    cells = counts.groupBy("source", (F.col("place") / 1024).cast("int").alias("cell")).agg(F.sum("n_tokens").alias("tokens"))
    held: dict[str, list[tuple[int, int]]] = {}
    for r in cells.collect():  # at most CELLS rows a source
        held.setdefault(r.source, []).append((r.cell, r.tokens))
    shares = [Share(s, t, max(0, c), sum(n for _, n in held.get(s, []))) for s, (t, c) in sorted(wanted.items())]
    total = total_tokens if total_tokens is not None else all_tokens_total(shares) if full else exact_total(shares)
    asked = water_fill(shares, total)
    plan = []
    for s in shares:
        whole, rest = divmod(asked[s.source], s.tokens) if s.tokens else (0.0, 0.0)
        if whole >= s.cap:
            whole, rest = float(s.cap), 0.0
        end, before = 0, 0
        for cell, n in sorted(held.get(s.source, [])):
            if before + n <= rest:
                before, end = before + n, (cell + 1) * 1024
                continue
            # inside the last cell the hash is even: take the part that is missing
            end = cell * 1024 + int(1024 * (rest - before) / n)
            break
        plan.append((s.source, float(s.target), int(s.cap), int(s.tokens), int(whole), int(end)))
    chosen = spark.createDataFrame(plan, "source string, target_share double, max_repeats int, available_tokens long, whole int, below int")
    mixed = counts.join(F.broadcast(chosen), "source").withColumn("repeats", (F.col("whole") + F.when(F.col("place") < F.col("below"), 1).otherwise(0)).cast("int"))
    used = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"))
    report = chosen.join(used, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    # a handful of rows: one per source of the parameter table
    everything = W.partitionBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    all_tokens = F.sum("tokens").over(everything)
    report = report.select(
        "source",
        "target_share",
        "max_repeats",
        "available_tokens",
        "tokens",
        F.when(all_tokens > 0, F.col("tokens") / all_tokens).otherwise(0.0).alias("actual_share"),
        F.when(F.col("available_tokens") > 0, F.col("tokens") / F.col("available_tokens")).otherwise(0.0).alias("epochs"),
    )
    return mixed.filter("repeats > 0").select("doc_id", "source", "repeats", "n_tokens"), report
