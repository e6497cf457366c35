"""Writes as merges: what an upsert, an insert-or-ignore or a soft delete makes of two DataFrames.

Every operation is one join on the key; nothing is changed in place. Callers write the result as a new version (see `Snapshot`).

Defined results: rows with a null key never match and are kept as they are; repeated keys in the new rows collapse to the last by `order`
(or to the greatest row); extra columns on either side stay, null where a side hasn't got them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_by(rows: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """One row per key: the last by `order`, ties and no order by the greatest row."""
    rest = [c for c in rows.columns if c not in keys]
    if not rest:
        return rows.distinct()
    rank = F.struct(*(order or []), F.to_json(F.struct(*rest)))
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("__last")).select(*keys, "__last.*")


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], *, keep: list[str] = (), set_on_update: dict[str, Column] | None = None, order: list[str] | None = None) -> DataFrame:
    """`existing` with `new` merged in by key: known keys get the new values but for the columns `keep`; unknown keys are added.

    `set_on_update` are values for known keys that are written again, e.g. {"is_active": lit(True)}.
    """
    new = last_by(new, keys, order)
    columns = list(dict.fromkeys([*existing.columns, *new.columns]))
    old, add = existing.alias("o"), new.withColumn("__new", F.lit(True)).alias("n")
    on = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys]
    both = old.withColumn("__old", F.lit(True)).alias("o").join(add, on, "full_outer")
    known, written = F.col("o.__old").isNotNull(), F.col("n.__new").isNotNull()
    out = []
    for c in columns:
        if c in keys:
            out.append(F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c))
        elif c not in new.columns:
            value = F.col(f"o.{c}")
            out.append((F.when(known & written, set_on_update[c]).otherwise(value) if set_on_update and c in set_on_update else value).alias(c))
        elif c not in existing.columns:
            out.append(F.col(f"n.{c}").alias(c))
        elif c in keep:
            out.append(F.when(known, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c))
        else:
            new_value = F.when(known, set_on_update[c]).otherwise(F.col(f"n.{c}")) if set_on_update and c in set_on_update else F.col(f"n.{c}")
            out.append(F.when(written, new_value).otherwise(F.col(f"o.{c}")).alias(c))
    return both.select(*out)


def insert_or_ignore(existing: DataFrame, new: DataFrame, keys: list[str], *, order: list[str] | None = None) -> DataFrame:
    """`existing` and those rows of `new` whose key is unknown; of repeated new keys the first by `order` counts."""
    rest = [c for c in new.columns if c not in keys]
    if rest:
        rank = F.struct(*(order or []), F.to_json(F.struct(*rest)))
        new = new.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("__first")).select(*keys, "__first.*")
    else:
        new = new.distinct()
    return existing.unionByName(new.join(existing.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def flag_where(rows: DataFrame, keys: DataFrame, key: str, column: str, value: Column) -> DataFrame:
    """`rows` with `column` set to `value` where `key` is among `keys`; the soft delete and its undoing."""
    marked = keys.select(key).distinct().withColumn("__hit", F.lit(True))
    return rows.join(marked, key, "left").withColumn(column, F.when(F.col("__hit"), value).otherwise(F.col(column))).select(*rows.columns)


def hide_missing(notes: DataFrame, listing: DataFrame) -> DataFrame:
    """Notes whose id isn't in a full listing become hidden; others stay as they are."""
    seen = listing.select("note_id").distinct().withColumn("__seen", F.lit(True))
    hidden = F.when(F.col("__seen").isNull() & (F.col("visibility") == "active"), F.lit("hidden")).otherwise(F.col("visibility"))
    return notes.join(seen, "note_id", "left").withColumn("visibility", hidden).select(*notes.columns)


def retire_facts(facts: DataFrame, evidence: DataFrame, note_id: str) -> DataFrame:
    """Properties or edges that cite any evidence of a note, active or not, become inactive."""
    return flag_where(facts, evidence.filter(F.col("note_id") == note_id), "evidence_id", "is_active", F.lit(False))


def with_defaults(rows: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Schema evolution: columns that are missing are added with their default."""
    return rows.withColumns({c: v for c, v in defaults.items() if c not in rows.columns})
