"""Queries of the text operators by name, with SQL where SQL can state the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from notewarp.llm import link, mixing, packing, pii, spam, split, turns
from notewarp.session import cut, table


def _items(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, root, "notes"), table(spark, root, "transcript_segments"), table(spark, root, "size_limits")


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    """(note_id, item_kind, cut_kind) of every item over its limit."""
    return split.split_report(*_items(spark, root)).select("note_id", "item_kind", "cut_kind")


def p2_pieces(spark: SparkSession, root: str) -> DataFrame:
    """All pieces of the items over their limits."""
    return split.pieces(*_items(spark, root))


def p2_check(spark: SparkSession, root: str) -> DataFrame:
    """Per item that was cut: characters and checksum of its cores, pieces over the limit, and overlaps of another length."""
    return split.split_check(*_items(spark, root))


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    """(note_id, first_segment_id, last_segment_id) of every speaker turn."""
    return turns.speaker_turns(table(spark, root, "transcript_segments"), text=False).select("note_id", "first_segment_id", "last_segment_id")


def p3_turns(spark: SparkSession, root: str) -> DataFrame:
    """Speaker turns with speaker, times and clean text."""
    return turns.speaker_turns(table(spark, root, "transcript_segments")).drop("voice")


def p4_entities(spark: SparkSession, root: str) -> DataFrame:
    """(record_id, kind, entity, n_links) of the records that name a person or a company."""
    return link.with_links(_linked(spark, root))


def _linked(spark: SparkSession, root: str) -> DataFrame:
    return cut(link.linked_records(table(spark, root, "entities"), table(spark, root, "extracted_entities")))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    """(id_a, id_b): pairs of records of one person or company."""
    return link.record_pairs(_linked(spark, root))


def _texts(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    return pii.free_texts(table(spark, root, "notes"), table(spark, root, "transcript_segments"), table(spark, root, "citations"))


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    """(record_kind, record_id, pii_type, start_pos) of all personal information in free text."""
    return pii.spans(*_texts(spark, root)).drop("end_pos")


def p6_redacted(spark: SparkSession, root: str) -> DataFrame:
    """The free texts with typed placeholders."""
    return pii.redacted(*_texts(spark, root))


def p7_containers(spark: SparkSession, root: str) -> DataFrame:
    """Where every document goes, in containers of both sizes."""
    return packing.containers(table(spark, root, "documents"), table(spark, root, "size_limits"))


def p7_fill(spark: SparkSession, root: str) -> DataFrame:
    """How full the containers of each size are."""
    return packing.fill_report(p7_containers(spark, root), table(spark, root, "size_limits"))


#: Limits of `p7_bound`: on these texts some containers are full in each of the three dimensions first.
BOUND_SEGMENTS, BOUND_LOSS = 12, 0.9


def p7_bound(spark: SparkSession, root: str) -> DataFrame:
    """Where every document goes if segments and loss-bearing tokens are limited so that all three limits bind."""
    return packing.containers(table(spark, root, "documents"), table(spark, root, "size_limits"), max_segments=BOUND_SEGMENTS, loss_share=BOUND_LOSS)


def p7_use(spark: SparkSession, root: str) -> DataFrame:
    """Use of each dimension by the containers of `p7_bound`."""
    return packing.use_report(p7_bound(spark, root), table(spark, root, "size_limits"), max_segments=BOUND_SEGMENTS, loss_share=BOUND_LOSS)


def p8_mixture(spark: SparkSession, root: str) -> DataFrame:
    """Documents of a mixture of all tokens the weighted sources have, and how often each is used."""
    return mixing.mixture(table(spark, root, "documents"), table(spark, root, "source_weights"))[0]


def p8_shares(spark: SparkSession, root: str) -> DataFrame:
    """Target and actual share of every source."""
    return mixing.mixture(table(spark, root, "documents"), table(spark, root, "source_weights"))[1]


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    """doc_id of keyword-stuffed pages, link lists and tag dumps."""
    return spam.spam_pages(table(spark, root, "documents"))


QUERIES = {"p4_found": p4_found, "p4_entities": p4_entities, "p6_found": p6_found, "p6_redacted": p6_redacted, "p7_containers": p7_containers, "p7_fill": p7_fill, "p7_bound": p7_bound, "p7_use": p7_use, "p8_mixture": p8_mixture, "p8_shares": p8_shares, "p9_found": p9_found, "p2_found": p2_found, "p2_pieces": p2_pieces, "p2_check": p2_check, "p3_found": p3_found, "p3_turns": p3_turns}
_ITEMS = r"""n AS (SELECT id, arg_max(coalesce(summary_text, ''), (updated_at, detail_no)) AS t FROM notes GROUP BY 1),
d AS (SELECT note_id, start_time, regexp_replace(lower(text), '\s+', '', 'g') AS k, arg_min(text, segment_id) AS t, min(segment_id) AS s FROM transcript_segments GROUP BY 1, 2, 3),
x AS (SELECT 'summary' AS item_kind, id AS note_id, t FROM n
      UNION ALL SELECT 'transcript', note_id, string_agg(t, chr(10) ORDER BY start_time, s) FROM d GROUP BY note_id)"""
ORACLE: dict[str, str] = {
    "p2_found": rf"""WITH {_ITEMS}
SELECT note_id, item_kind, CASE WHEN list_max(list_transform(regexp_split_to_array(t, '\s+'), lambda w: length(w))) > max_size THEN 'inside_word' ELSE 'natural' END AS cut_kind
FROM x JOIN size_limits USING (item_kind) WHERE length(t) > max_size""",
    "p2_check": f"""WITH {_ITEMS}
SELECT note_id, item_kind, length(t) AS n_chars, CAST(list_sum(list_transform(range(1, length(t) + 1), lambda i: CAST(unicode(t[i]) AS BIGINT) * ((i - 1) % 9973 + 1))) AS BIGINT) AS checksum, CAST(0 AS BIGINT) AS n_too_long, CAST(0 AS BIGINT) AS n_bad_overlap
FROM x JOIN size_limits USING (item_kind) WHERE length(t) > max_size""",
}
