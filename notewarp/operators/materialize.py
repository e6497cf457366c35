"""Notes into evidence units: content-addressed, soft-deleted, never changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewarp.functions.scalar import digest, evidence_id, strip
from notewarp.operators.merge import upsert


def current_notes(details: DataFrame) -> DataFrame:
    """The current row of each note: greatest updated_at, then greatest detail_no."""
    rest = [c for c in details.columns if c != "id"]
    return details.filter("id is not null").groupBy("id").agg(F.max_by(F.struct(*rest), F.struct("updated_at", "detail_no")).alias("n")).select("id", "n.*")


def flat_notes(details: DataFrame) -> DataFrame:
    """A note as a row: event fields are null where there is no event; the content digest covers the whole record."""
    raw = F.to_json(F.struct(*details.columns))
    return details.select(
        F.col("id").alias("note_id"),
        "title",
        F.col("owner.name").alias("owner_name"),
        F.col("owner.email").alias("owner_email"),
        "web_url",
        F.col("calendar_event.calendar_event_id").alias("calendar_event_id"),
        F.col("calendar_event.scheduled_start_time").alias("scheduled_start"),
        F.col("calendar_event.scheduled_end_time").alias("scheduled_end"),
        "created_at",
        "updated_at",
        digest(raw).alias("content_hash"),
        F.transform("folder_membership", lambda f: f["id"]).alias("folder_ids"),
        F.lit("active").alias("visibility"),
    )


def _units(rows: DataFrame, kind: str) -> DataFrame:
    body = strip(F.col("content"))
    rows = rows.withColumn("content", body).filter(F.coalesce(F.col("content"), F.lit("")) != "")
    hashed = rows.withColumn("content_hash", digest(F.col("content"))).withColumn("unit_kind", F.lit(kind))
    return hashed.withColumn("evidence_id", evidence_id(F.col("note_id"), F.col("unit_kind"), F.col("unit_index"), F.col("content_hash"))).withColumn("is_active", F.lit(True))


def summary_units(notes: DataFrame) -> DataFrame:
    """The summary of a note is unit 0, if it isn't blank."""
    return _units(notes.select(F.col("id").alias("note_id"), F.lit(0).cast("long").alias("unit_index"), F.col("summary_text").alias("content")), "summary")


def nested_transcript_units(notes: DataFrame) -> DataFrame:
    """The transcript array of a note as rows; blank ones are left out and the others keep their index."""
    rows = notes.select(F.col("id").alias("note_id"), F.posexplode("transcript").alias("unit_index", "t"))
    rows = rows.select("note_id", F.col("unit_index").cast("long"), F.col("t.text").alias("content"), F.col("t.speaker.name").alias("speaker_name"), F.col("t.start_time").alias("started_at"), F.col("t.end_time").alias("ended_at"))
    return _units(rows, "transcript")


def segment_units(segments: DataFrame) -> DataFrame:
    """Transcript rows that are delivered one by one: the unit's index is the segment's number."""
    rows = segments.select("note_id", F.col("segment_id").alias("unit_index"), F.col("text").alias("content"), F.col("speaker.name").alias("speaker_name"), F.col("start_time").alias("started_at"), F.col("end_time").alias("ended_at"))
    return _units(rows, "transcript")


def refresh_evidence(existing: DataFrame, units: DataFrame, notes: DataFrame) -> DataFrame:
    """All units of the given notes become inactive, then those that are there are added or made active again."""
    touched = notes.select("note_id").distinct().withColumn("__t", F.lit(True))
    asleep = existing.join(touched, "note_id", "left").withColumn("is_active", F.when(F.col("__t"), F.lit(False)).otherwise(F.col("is_active"))).drop("__t")
    keep = [c for c in units.columns if c not in ("evidence_id", "is_active")]
    return upsert(asleep, units, ["evidence_id"], keep=keep)
