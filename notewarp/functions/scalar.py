"""Scalar expressions: identities, digests, JSON, times, limits. All of them run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Namespace of name-based identifiers (the one for URLs).
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"
#: Prefix of the name from which a meeting's identifier is made; a deployment that shares identifiers sets its own.
MEETING_PREFIX = "note:"
#: Form of a key of the ontology.
KEY_PATTERN = r"^[a-z][a-z0-9_]*$"


def digest(text: Column) -> Column:
    """Hex SHA-256."""
    return F.sha2(text, 256)


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"^[\s ]+|[\s ]+$", "")


def evidence_id(note_id: Column, kind: Column, index: Column, content_hash: Column) -> Column:
    """Content-addressed identifier of an evidence unit."""
    return F.concat(F.lit("ev_"), F.substring(digest(F.concat_ws(":", note_id, kind, index.cast("string"), content_hash)), 1, 32))


def uuid5(name: Column) -> Column:
    """Name-based identifier (version 5) in the namespace of URLs."""
    h = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(name, "utf-8")))
    part = lambda start, length: F.substring(h, start, length)
    variant = F.substring(F.lit("89ab"), (F.conv(part(17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def meeting_id(note_id: Column, *, prefix: str = MEETING_PREFIX) -> Column:
    return uuid5(F.concat(F.lit(prefix), strip(note_id)))


def property_id(entity: Column, field: Column, evidence: Column) -> Column:
    return uuid5(F.concat_ws(":", entity, field, evidence))


def edge_id(source: Column, relation: Column, target: Column, evidence: Column) -> Column:
    return uuid5(F.concat_ws(":", source, relation, target, evidence))


def group_key(*parts: Column) -> Column:
    return F.concat_ws(":", *parts)


def iso_utc(at: Column) -> Column:
    """Time in UTC with `Z`."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def estimated_tokens(json_text: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.char_length(json_text) / 4)


def clamp(value: int, low: int, high: int) -> int:
    return max(low, min(value, high))


def backoff_seconds(attempt: int, *, longest: float = 30.0) -> float:
    return min(2.0**attempt, longest)


def is_key(text: Column) -> Column:
    return text.rlike(KEY_PATTERN)


def label(text: Column, *, longest: int = 28, kept: int = 26) -> Column:
    """A label that fits: cut to `kept` characters and an ellipsis where it is longer than `longest`."""
    return F.when(F.char_length(text) > longest, F.concat(F.substring(text, 1, kept), F.lit("…"))).otherwise(text)


def palette_index(text: Column, colours: int) -> Column:
    """Stable colour number of a text: a 32-bit rolling hash of its characters."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    # h * 31 + c, wrapped to a signed 32-bit number at each step
    wrap = lambda x: F.pmod(x + F.lit(2**31), F.lit(2**32)) - F.lit(2**31)
    return (F.abs(F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: wrap(h * 31 + c))) % colours).cast("int")


def circle_layout(index: Column, count: Column) -> tuple[Column, Column]:
    """(x, y) of node `index` of `count` on a sunflower spiral."""
    angle = index * F.lit(2.399963)
    radius = F.lit(55) + F.lit(265) * F.sqrt((index + 1) / count)
    return radius * F.cos(angle), radius * F.sin(angle)


def json_items(text: Column) -> Column:
    """The strings of a JSON list; an empty array where it is null or no list."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))
