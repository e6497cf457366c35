"""Which notes the next run must process, from the feed of versions and the log of queue states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewarp.operators.merkle import MerkleStore
from notewarp.session import cut, scratch

#: Attempts after which a version is given up.
MAX_ATTEMPTS = 5


def note_state(feed: DataFrame, queue: DataFrame, *, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """One row per note of the feed: its newest version and the version that counts as settled, both as strings.

    Feed and queue rows are unioned and aggregated twice, first by (note, version), so that a note with a third of all rows is
    combined on the map side. `settled` equals `newest` where a complete row has that or a later version or where exactly that
    version has used up its attempts; it is another value where the note's newest queue row is pending with force_reprocess.
    Null ids and versions are ignored.
    """
    versions = feed.select(
        F.col("id").alias("note_id"),
        F.col("updated_at").cast("timestamp").alias("version"),
        F.lit(True).alias("fed"),
        F.lit(None).cast("int").alias("attempts"),
        F.lit(False).alias("complete"),
        F.lit(None).cast("struct<seq:bigint,forced:boolean>").alias("last"),
    )
    states = queue.select(
        "note_id",
        F.col("remote_updated_at").cast("timestamp").alias("version"),
        F.lit(False).alias("fed"),
        F.col("attempts").cast("int").alias("attempts"),
        F.coalesce(F.col("state") == "complete", F.lit(False)).alias("complete"),
        F.when(
            F.col("queue_seq").isNotNull(),
            F.struct(F.col("queue_seq").cast("long").alias("seq"), F.coalesce((F.col("state") == "pending") & F.col("force_reprocess"), F.lit(False)).alias("forced")),
        ).alias("last"),
    )
    by_version = (
        versions.unionByName(states)
        .filter("note_id is not null")
        .groupBy("note_id", "version")
        .agg(F.max("fed").alias("fed"), F.max("attempts").alias("attempts"), F.max("complete").alias("complete"), F.max("last").alias("last"))
    )
    known = F.col("version").isNotNull()
    by_note = by_version.groupBy("note_id").agg(
        F.max(F.when(F.col("fed") & known, F.struct("version", "attempts"))).alias("newest"),
        F.max(F.when(F.col("complete") & known, F.col("version"))).alias("completed"),
        F.max("last").alias("last"),
    )
    newest = F.unix_micros("newest.version")
    settled = (F.col("completed") >= F.col("newest.version")) | (F.col("newest.attempts") >= max_attempts)
    return by_note.filter("newest is not null").select(
        F.col("note_id").alias("key"),
        newest.cast("string").alias("newest"),
        F.when(F.coalesce(F.col("last.forced"), F.lit(False)), F.lit("forced"))
        .when(settled, newest.cast("string"))
        .otherwise(F.coalesce(F.unix_micros("completed").cast("string"), F.lit("never")))
        .alias("settled"),
    )


def due_notes(feed: DataFrame, queue: DataFrame, *, max_attempts: int = MAX_ATTEMPTS, store: MerkleStore | None = None) -> DataFrame:
    """(note_id, version_us) of each note to process, once.

    What earlier runs have settled is what the queue's log says: it is published as the store's version in force. The run over the feed's
    newest versions then reads that saved tree, goes down where digests differ, and compares the records of those leaves.
    """
    spark = feed.sparkSession
    state = cut(note_state(feed, queue, max_attempts=max_attempts))
    store = store or MerkleStore(spark, scratch(spark))
    settled = state.filter("settled <> 'never'").select("key", F.col("settled").alias("digest"))
    store.publish(settled, settled.limit(0))
    # notes that only the saved side has can't be there: both sides are notes of the feed
    rows = store.pending(state.select("key", F.col("newest").alias("digest")))
    return rows.select(F.col("key").alias("note_id"), F.col("digest").cast("long").alias("version_us"))


def newest_versions(feed: DataFrame) -> DataFrame:
    """(key, digest): a note and its newest version in microseconds."""
    newest = feed.filter("id is not null and updated_at is not null").groupBy(F.col("id").alias("key")).agg(F.max(F.col("updated_at").cast("timestamp")).alias("v"))
    return newest.select("key", F.unix_micros("v").cast("string").alias("digest"))
