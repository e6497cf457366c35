"""What an extractor is shown of a note and of the ontology, within budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from notewarp.functions.text import overlap, overlap_words

# Characters of evidence, rows of the ontology.
EVIDENCE_CHARACTERS, ONTOLOGY_ROWS = 12_000, 48
#: Parts in which a note's units are thinned out.
PARTS = 32


def evidence_context(evidence: DataFrame, notes: DataFrame, *, budget: int = EVIDENCE_CHARACTERS) -> DataFrame:
    """(note_id, place, evidence_id, unit_kind, content) of every note: summaries, then transcript units by the words they share with
    title and summary, until the budget of characters is used up; the last one is cut.

    The order within a note is a window over at most PARTS budgets of its units.
    """
    active = evidence.filter("is_active")
    about = active.filter("unit_kind = 'summary'").groupBy("note_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("unit_index", "content"))), lambda s: s["content"]), " ").alias("summary"))
    wanted = notes.select("note_id", "title").join(about, "note_id", "left").select("note_id", overlap_words(F.concat_ws(" ", "title", "summary")).alias("wanted"))
    rows = active.join(wanted, "note_id").withColumn("shared", F.when(F.col("unit_kind") == "summary", 0).otherwise(overlap(overlap_words(F.col("content")), F.col("wanted"))))
    by = [F.when(F.col("unit_kind") == "summary", 0).otherwise(1), F.desc("shared"), "unit_index", "evidence_id"]
    # what doesn't fit within a part of a note's units doesn't fit within all of them: a hot note is thinned out in parts first
    part = W.partitionBy("note_id", "part").orderBy(*by).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("evidence_id"), F.lit(PARTS))).withColumn("in_part", F.coalesce(F.sum(F.char_length("content")).over(part), F.lit(0))).filter(F.col("in_part") < budget)
    order = W.partitionBy("note_id").orderBy(*by)
    before = F.coalesce(F.sum(F.char_length("content")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumn("place", F.row_number().over(order)).withColumn("before", before).filter(F.col("before") < budget)
    return placed.select("note_id", F.col("place").cast("long").alias("place"), "evidence_id", "unit_kind", F.expr(f"substring(content, 1, {budget} - cast(before as int))").alias("content"))


def ontology_context(types: DataFrame, fields: DataFrame, relations: DataFrame, context: str, *, rows: int = ONTOLOGY_ROWS) -> tuple[DataFrame, DataFrame]:
    """(types with fields, relations): seeds first, then by the words shared with `context`; relations whose two ends were chosen."""
    wanted = overlap_words(F.lit(context))
    joined = types.join(fields.select("type_key", "field_key", F.col("display_name").alias("field_name"), "data_type", "is_identifier"), "type_key", "left")
    words = overlap_words(F.concat_ws(" ", "type_key", "display_name", "description", F.coalesce("field_key", F.lit("")), F.coalesce("field_name", F.lit(""))))
    ranked = joined.withColumn("shared", overlap(words, wanted))
    chosen = ranked.orderBy(F.when(F.col("is_seed"), 0).otherwise(1), F.desc("shared"), "type_key", F.col("field_key").asc_nulls_first()).limit(rows)
    chosen = chosen.select("type_key", "display_name", "description", "identity_scope", "is_seed", "field_key", "data_type", "is_identifier", "shared")
    keys = F.broadcast(chosen.select("type_key").distinct())  # at most `rows` keys
    ends = relations.join(keys.withColumnRenamed("type_key", "source_type_key"), "source_type_key", "left_semi").join(keys.withColumnRenamed("type_key", "target_type_key"), "target_type_key", "left_semi")
    return chosen, ends.orderBy("relation_key").limit(rows)
