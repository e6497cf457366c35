"""The processing queue and the high-water mark, as set operations on keyed state.

States: pending -> processing -> complete or failed; failed -> processing while attempts are left; anything -> pending on a change or a
reprocess. A batch of rows is claimed at once; every operation returns the new queue, to be committed as a version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewarp.operators.merge import last_by, upsert

# States, and the bound on attempts.
STATES = ["pending", "processing", "complete", "failed"]
MAX_ATTEMPTS = 5
QUEUE = "note_id string, remote_updated_at timestamp, state string, attempts int, last_error string, force_reprocess boolean, queued_at timestamp, updated_at timestamp"


def newest_rows(log: DataFrame) -> DataFrame:
    """The present state of each note from a log of states: its row with the greatest queue_seq."""
    rest = [c for c in log.columns if c != "note_id"]
    return log.filter("note_id is not null").groupBy("note_id").agg(F.max_by(F.struct(*rest), "queue_seq").alias("s")).select("note_id", "s.*")


def discover(queue: DataFrame, feed: DataFrame, *, now=None) -> DataFrame:
    """The queue after a batch of the feed (id, updated_at): unseen notes and newer versions become pending with no attempts."""
    now = F.current_timestamp() if now is None else F.lit(now)
    newest = feed.filter("id is not null").groupBy(F.col("id").alias("note_id")).agg(F.max("updated_at").alias("remote_updated_at"))
    old = queue.select("note_id", F.col("remote_updated_at").alias("known"))
    fresh = newest.join(old, "note_id", "left").filter(F.col("known").isNull() | (F.col("known") < F.col("remote_updated_at"))).drop("known")
    rows = fresh.select("note_id", "remote_updated_at", F.lit("pending").alias("state"), F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("last_error"), F.lit(False).alias("force_reprocess"), now.alias("queued_at"), now.alias("updated_at"))
    return upsert(queue, rows, ["note_id"])


def claimable(queue: DataFrame, *, max_attempts: int = MAX_ATTEMPTS, limit: int | None = None) -> DataFrame:
    """Rows that may be processed, oldest first."""
    rows = queue.filter(F.col("state").isin("pending", "failed") & (F.col("attempts") < max_attempts))
    rows = rows.orderBy("updated_at", "queued_at", "note_id")
    return rows if limit is None else rows.limit(limit)


def claim(queue: DataFrame, *, max_attempts: int = MAX_ATTEMPTS, limit: int | None = None, now=None) -> tuple[DataFrame, DataFrame]:
    """(queue, claimed): claimed rows are processing, with one attempt more."""
    now = F.current_timestamp() if now is None else F.lit(now)
    taken = claimable(queue, max_attempts=max_attempts, limit=limit).withColumn("state", F.lit("processing")).withColumn("attempts", F.col("attempts") + 1).withColumn("updated_at", now)
    return upsert(queue, taken, ["note_id"]), taken


def finish(queue: DataFrame, outcome: DataFrame, *, now=None) -> DataFrame:
    """The queue after (note_id, error): without an error complete, else failed. Only rows that are processing change state."""
    now = F.current_timestamp() if now is None else F.lit(now)
    done = last_by(outcome.select("note_id", "error"), ["note_id"]).withColumn("__done", F.lit(True))
    joined = queue.join(done, "note_id", "left")
    hit = F.coalesce(F.col("__done"), F.lit(False)) & (F.col("state") == "processing")
    return joined.select(
        *[
            F.when(hit, F.when(F.col("error").isNull(), "complete").otherwise("failed")).otherwise(F.col("state")).alias("state") if c == "state"
            else F.when(hit, F.col("error")).otherwise(F.col("last_error")).alias(c) if c == "last_error"
            else F.when(hit, now).otherwise(F.col(c)).alias(c) if c == "updated_at"
            else F.col(c)
            for c in queue.columns
        ]
    )


def not_processing(queue: DataFrame, outcome: DataFrame) -> DataFrame:
    """Ids of an outcome that may not be finished: unknown, or not processing."""
    return outcome.select("note_id").distinct().join(queue.filter("state = 'processing'"), "note_id", "left_anti")


def settle(queue: DataFrame, outcome: DataFrame, *, now=None) -> DataFrame:
    """`finish`, but an outcome of a row that isn't processing, or isn't there, is an error."""
    bad = [r.note_id for r in not_processing(queue, outcome).limit(5).collect()]
    if bad:
        raise ValueError(f"not being processed: {', '.join(map(str, bad))}")
    return finish(queue, outcome, now=now)


def begin(state: DataFrame, source: str, *, now=None) -> DataFrame:
    """sync_state when a pass begins: its start is noted, mark and last error stay."""
    now = F.current_timestamp() if now is None else F.lit(now)
    spark = state.sparkSession
    new = spark.createDataFrame([(source,)], "source_key string").withColumn("last_started_at", now.cast("timestamp"))
    return upsert(state, new, ["source_key"]).select("source_key", F.col("watermark").cast("timestamp").alias("watermark"), "last_started_at", F.col("last_completed_at").cast("timestamp").alias("last_completed_at"), "last_error")


def recover(queue: DataFrame) -> DataFrame:
    """Interrupted rows wait again."""
    return queue.withColumn("state", F.when(F.col("state") == "processing", "pending").otherwise(F.col("state")))


def reprocess(queue: DataFrame, notes: DataFrame | None = None, *, now=None) -> DataFrame:
    """The given notes (note_id), or all, become pending with the force flag and no attempts."""
    now = F.current_timestamp() if now is None else F.lit(now)
    which = queue.select("note_id") if notes is None else notes.select("note_id").join(queue.select("note_id"), "note_id", "left_semi")
    rows = queue.join(which.distinct(), "note_id", "left_semi").withColumn("state", F.lit("pending")).withColumn("attempts", F.lit(0)).withColumn("last_error", F.lit(None).cast("string")).withColumn("force_reprocess", F.lit(True)).withColumn("updated_at", now)
    return upsert(queue, rows, ["note_id"])


def counts(queue: DataFrame) -> DataFrame:
    """(state, n) of the four states, zero where there is no row."""
    spark = queue.sparkSession
    states = spark.createDataFrame([(s,) for s in STATES], "state string")
    return states.join(queue.groupBy("state").agg(F.count("*").alias("n")), "state", "left").select("state", F.coalesce("n", F.lit(0)).alias("n"))


def skippable(claimed: DataFrame, notes: DataFrame) -> DataFrame:
    """Claimed notes whose content was processed before and isn't forced."""
    same = notes.filter(F.col("processed_hash") == F.col("content_hash")).select("note_id")
    return claimed.filter(~F.col("force_reprocess")).join(same, "note_id", "left_semi")


def advance(state: DataFrame, source: str, feed: DataFrame, *, error: str | None = None, now=None) -> DataFrame:
    """sync_state after a pass over `feed`: the mark moves to the greatest updated_at if the pass ended well, and never back."""
    now = F.current_timestamp() if now is None else F.lit(now)
    top = feed.agg(F.max("updated_at").cast("timestamp").alias("top")).withColumn("source_key", F.lit(source))
    joined = state.withColumn("watermark", F.col("watermark").cast("timestamp")).join(top, "source_key", "full_outer")
    ours = F.col("source_key") == source
    if error is not None:
        return joined.select("source_key", "watermark", "last_started_at", "last_completed_at", F.when(ours, F.lit(error)).otherwise(F.col("last_error")).alias("last_error"))
    return joined.select(
        "source_key",
        F.when(ours, F.greatest("watermark", "top")).otherwise(F.col("watermark")).alias("watermark"),
        "last_started_at",
        F.when(ours, now).otherwise(F.col("last_completed_at").cast("timestamp")).alias("last_completed_at"),
        F.when(ours, F.lit(None).cast("string")).otherwise(F.col("last_error")).alias("last_error"),
    )


def after_mark(feed: DataFrame, state: DataFrame, source: str) -> DataFrame:
    """Rows of the feed newer than the source's mark; all, where it has none."""
    mark = state.filter(F.col("source_key") == source).select("watermark").first()
    return feed if mark is None or mark[0] is None else feed.filter(F.col("updated_at") > F.lit(mark[0]))
