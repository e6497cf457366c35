"""Splitting oversized items at natural boundaries, with a fixed overlap between neighbours.

Agglomerative merging: an item starts as atoms (sentences and lines; an atom that can't fit is broken at clauses, words, and at last
inside a word). Adjacent pairs wait in a heap, weakest boundary first and smaller union first; a pair is merged while its size plus
the overlap fits the limit. What is left are the cores of the pieces; each piece but the first is preceded by the last `overlap`
characters before its core. Sizes count Unicode code points. A word that fits a piece but not beside the overlap is cut where the overlap
of the next piece begins with it, so that this piece has it whole.

A transcript is put together in blocks of about BLOCK_CHARS characters that end between segments, so no task holds more of a hot
note than that. The result is that of the whole text: a merge depends on the pairs beside it only, so a block decides all merges but
those that hang on what lies beyond its edges. What hangs on an edge, up to the next pair that can't be merged any more, is handed on and
merged together with its counterpart of the next block.

Defined results: null texts are empty; items of at most the limit give no pieces; an item kind without a row of limits is left out;
repeated rows of a note: the greatest updated_at, then the greatest detail_no; the boundary between segments is a line; an overlap that
isn't below the limit is an error.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from notewarp.llm.turns import distinct_segments, in_buckets
from notewarp.operators.ordered import running_total
from notewarp.session import cut

#: Characters of a transcript put together in one row, about.
BLOCK_CHARS = 262_144

# Strength of a boundary, weakest first. SHARED is inside a word that the next piece's overlap begins with.
INSIDE, SHARED, WORD, CLAUSE, SENTENCE, LINE, PARAGRAPH = range(7)
STRENGTH_NAMES = ["inside_word", "shared_word", "word", "clause", "sentence", "line", "paragraph"]
_COARSE = re.compile(r"\n[^\S\n]*\n\s*|\n|[.!?…]+[\"'”’»)\]]*\s+")
_FINE = re.compile(r"([,;:]?)(\s+)")

PARTS = "item_kind string, note_id string, block long, side int, atoms array<struct<s:bigint,e:bigint,k:int>>, before string, text string"
PIECES = "item_kind string, note_id string, core_start long, core_end long, boundary string, text string"


def _kind(sep: str) -> int:
    if "\n" in sep:
        return PARAGRAPH if sep.count("\n") > 1 else LINE
    return SENTENCE


def _broken(text: str, start: int, end: int, first: int, room: int, overlap: int) -> list[tuple[int, int, int]]:
    """Atoms of a sentence or line that doesn't fit: clauses and words, and parts of words that don't fit."""
    out, s, k = [], start, first
    bounds = [(m.start(2), m.end(), CLAUSE if m.group(1) else WORD) for m in _FINE.finditer(text, start, end) if m.end() < end]
    tail = _FINE.search(text, bounds[-1][1] if bounds else start, end)
    bounds.append((tail.start(2) if tail else end, end, WORD))
    for word, e, after in bounds:
        if e - s > room:
            if word - s > room + overlap:
                while word - s > room:
                    out.append((s, s + room, k))
                    s, k = s + room, INSIDE
            elif word - s > room:
                # the overlap before the last part must reach back to the word's beginning
                last = s + overlap if overlap <= room else word - room
                while s < last:
                    out.append((s, min(last, s + room), k))
                    s, k = out[-1][1], SHARED
            while e - s > room:
                # a stretch of white space that fits nowhere
                at = word if s < word else s + room
                out.append((s, at, k))
                s, k = at, WORD
        if e > s:
            out.append((s, e, k))
        s, k = e, after
    return out


def atoms(text: str, room: int, overlap: int = 0, first: int = PARAGRAPH) -> list[tuple[int, int, int]]:
    """(start, end, strength of the boundary before) of consecutive atoms that cover the text, none longer than `room`."""
    ends, at = [], 0
    for m in _COARSE.finditer(text):
        if m.end() > at:
            ends.append((m.end(), _kind(m.group())))
            at = m.end()
    if at < len(text):
        ends.append((len(text), PARAGRAPH))
    out, start, strength = [], 0, first
    for end, after in ends:
        if end - start <= room:
            out.append((start, end, strength))
        else:
            out += _broken(text, start, end, strength, room, overlap)
        start, strength = end, after
    return out


def merge_atoms(parts: list[tuple[int, int, int]], room: int, *, open_left: bool = False, open_right: bool = False) -> tuple[list[tuple[int, int, int]], int, int]:
    """(cores, n_left, n_right): cores after merging weakest boundaries first, and how many at either end hang on an open edge.

    A pair is merged unless a pair beside it waits for what lies beyond an edge; pairs come in ascending order, so what waits is weaker
    and goes first. At an open edge the pair across it is unknown, and waits.
    """
    n = len(parts)
    start, end, strength = [p[0] for p in parts], [p[1] for p in parts], [p[2] for p in parts]
    left, right, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
    # waits[i]: the pair of i and the core before it waits
    waits = [False] * (n + 1)
    waits[0], waits[n] = open_left, open_right
    heap = [(strength[i], end[i] - start[i - 1], i, i - 1) for i in range(1, n) if end[i] - start[i - 1] <= room]
    heapq.heapify(heap)
    while heap:
        _, size, i, j = heapq.heappop(heap)
        if not (alive[i] and alive[j]) or left[i] != j or end[i] - start[j] != size:
            continue
        if waits[j] or waits[right[i]]:
            waits[i] = True
            continue
        alive[i] = False
        end[j], right[j] = end[i], right[i]
        if right[i] < n:
            k = right[i]
            left[k] = j
            if end[k] - start[j] <= room:
                heapq.heappush(heap, (strength[k], end[k] - start[j], k, j))
        if left[j] >= 0 and end[j] - start[left[j]] <= room:
            heapq.heappush(heap, (strength[j], end[j] - start[left[j]], j, left[j]))
    kept = [i for i in range(n) if alive[i]]
    n_left = n_right = 0
    if open_left and kept:
        n_left = next((at for at, i in enumerate(kept) if at and not waits[i]), len(kept))
    if open_right and kept:
        n_right = next((at for at, i in enumerate(reversed(kept), 1) if not waits[i]), len(kept))
    return [(start[i], end[i], strength[i]) for i in kept], n_left, n_right


def merged(text: str, room: int) -> list[tuple[int, int, int]]:
    """Cores of a whole text."""
    return merge_atoms(atoms(text, room), room)[0]


def split_text(text: str, max_size: int, overlap: int) -> list[tuple[int, int, int, str]]:
    """(core start, core end, strength, piece text) of a whole text."""
    if not 0 <= overlap < max_size:
        raise ValueError("the overlap must be below the size limit")
    if not text:
        return []
    if len(text) <= max_size:
        return [(0, len(text), PARAGRAPH, text)]
    room = max_size - overlap
    return [(s, e, k, text[max(0, s - overlap) : e]) for s, e, k in merge_atoms(atoms(text, room, overlap), room)[0]]


def _split(sizes: dict[str, tuple[int, int]]):
    """Blocks (item_kind, note_id, block, offset, before, texts, last) into pieces (side -1) and what hangs on an edge (0 left, 1 right)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["item_kind", "note_id", "block", "side", "atoms", "before", "text"]
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                max_size, overlap = sizes[r.item_kind]
                room, found, at, texts = max_size - overlap, [], 0, list(r.texts)
                for i, t in enumerate(texts):
                    t = t if r.last and i == len(texts) - 1 else t + "\n"
                    found += [(at + s, at + e, k) for s, e, k in atoms(t, room, overlap, LINE if i or r.block else PARAGRAPH)]
                    at += len(t)
                body = "\n".join(texts) + ("" if r.last else "\n")
                cores, n_left, n_right = merge_atoms(found, room, open_left=r.block > 0, open_right=not r.last)
                before = r.before or ""
                whole, shift = before + body, len(before)

                def part(side, some, r=r, whole=whole, shift=shift, overlap=overlap):
                    s, e = some[0][0], some[-1][1]
                    return (r.item_kind, r.note_id, r.block, side, [(r.offset + a, r.offset + b, k) for a, b, k in some], whole[max(0, shift + s - overlap) : shift + s], whole[shift + s : shift + e])

                if n_left + n_right > len(cores) or n_left == len(cores) > 0:
                    out.append(part(0, cores))
                    continue
                if n_left:
                    out.append(part(0, cores[:n_left]))
                out += [part(-1, [c]) for c in cores[n_left : len(cores) - n_right]]
                if n_right:
                    out.append(part(1, cores[len(cores) - n_right :]))
            yield pd.DataFrame(out, columns=columns)

    return run


def _joined(sizes: dict[str, tuple[int, int]]):
    """What hangs together across edges, as pieces."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["block", "side"])
        first = pdf.iloc[0]
        max_size, overlap = sizes[first["item_kind"]]
        text = first["before"] + "".join(pdf["text"])
        found = [(a["s"], a["e"], a["k"]) for some in pdf["atoms"] for a in some]
        shift = len(first["before"]) - found[0][0]
        cores = merge_atoms(found, max_size - overlap)[0]
        rows = [(first["item_kind"], first["note_id"], s, e, STRENGTH_NAMES[k], text[max(0, shift + s - overlap) : shift + e]) for s, e, k in cores]
        return pd.DataFrame(rows, columns=["item_kind", "note_id", "core_start", "core_end", "boundary", "text"])

    return run


def limits_of(limits: DataFrame) -> dict[str, tuple[int, int]]:
    """Kind -> (max_size, overlap_size) of the two kinds of this project; at most two rows."""
    known = limits.filter("item_kind in ('summary', 'transcript') and max_size > 0").groupBy("item_kind").agg(F.max("max_size").alias("m"), F.max(F.coalesce("overlap_size", F.lit(0))).alias("o"))
    sizes = {r.item_kind: (int(r.m), int(r.o)) for r in known.collect()}
    if any(o >= m for m, o in sizes.values()):
        raise ValueError("the overlap must be below the size limit")
    return sizes


def oversized(notes: DataFrame, segments: DataFrame, sizes: dict[str, tuple[int, int]], *, block_chars: int | None = None) -> DataFrame:
    """Blocks of all items over their limit: item_kind, note_id, block, offset, before, texts, last."""
    found = []
    if "summary" in sizes:
        current = notes.filter("id is not null").groupBy(F.col("id").alias("note_id")).agg(F.max_by(F.coalesce("summary_text", F.lit("")), F.struct("updated_at", "detail_no")).alias("text"))
        long = current.filter(F.char_length("text") > sizes["summary"][0])
        found.append(long.select(F.lit("summary").alias("item_kind"), "note_id", F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("offset"), F.lit("").alias("before"), F.array("text").alias("texts"), F.lit(True).alias("last")))
    if "transcript" in sizes:
        max_size, overlap = sizes["transcript"]
        rows = cut(distinct_segments(segments).select("note_id", "segment_id", "start_time", "text", F.char_length("text").alias("size")))
        large = rows.groupBy("note_id").agg((F.sum("size") + F.count("*") - 1).alias("total")).filter(F.col("total") > max_size).select("note_id")
        rows = in_buckets(rows.join(large, "note_id", "left_semi"))
        rows = running_total(rows, "note_id", "bucket", ["at", "segment_id"], F.col("size") + 1, "through")
        rows = rows.withColumn("block", F.expr(f"(through - size - 1) div {block_chars or BLOCK_CHARS}"))
        blocks = cut(
            rows.groupBy("note_id", "block").agg(
                F.transform(F.array_sort(F.collect_list(F.struct("at", "segment_id", "text"))), lambda s: s["text"]).alias("texts"), F.min(F.col("through") - F.col("size") - 1).alias("offset"), F.max("through").alias("end")
            )
        )
        # the overlap reaches back over the edge of a block; only these tails and places are put in order
        order = W.partitionBy("note_id").orderBy("block")
        tails = blocks.select("note_id", "block", F.expr(f"right(concat(array_join(slice(texts, greatest(1, size(texts) - {overlap + 1}), {overlap + 2}), '\n'), '\n'), {overlap})").alias("tail"))
        tails = tails.select("note_id", F.col("block"), F.lag("tail").over(order).alias("before"), F.lead("block").over(order).isNull().alias("last"))
        blocks = blocks.join(tails, ["note_id", "block"])
        nth = blocks.select(F.lit("transcript").alias("item_kind"), "note_id", F.when(F.col("offset") == 0, 0).otherwise(F.col("block") + 1).cast("long").alias("block"), "offset", F.coalesce("before", F.lit("")).alias("before"), "texts", "last")
        found.append(nth)
    if not found:
        return notes.sparkSession.createDataFrame([], "item_kind string, note_id string, block long, offset long, before string, texts array<string>, last boolean")
    return found[0].unionByName(found[1]) if len(found) > 1 else found[0]


def pieces(notes: DataFrame, segments: DataFrame, limits: DataFrame, *, block_chars: int | None = None) -> DataFrame:
    """(item_kind, note_id, core_start, core_end, boundary, text) of every item over its limit."""
    sizes = limits_of(limits)
    parts = cut(oversized(notes, segments, sizes, block_chars=block_chars).mapInPandas(_split(sizes), PARTS))
    names = F.element_at(F.array(*[F.lit(n) for n in STRENGTH_NAMES]), F.col("atoms")[0]["k"] + 1)
    done = parts.filter("side = -1").select("item_kind", "note_id", F.col("atoms")[0]["s"].alias("core_start"), F.col("atoms")[0]["e"].alias("core_end"), names.alias("boundary"), F.concat("before", "text").alias("text"))
    # a run begins at the right end of a block, or with a first block that hangs together as a whole
    edges = parts.filter("side >= 0")
    numbered = edges.select("item_kind", "note_id", "block", "side", F.sum(F.when((F.col("side") == 1), 1).otherwise(0)).over(W.partitionBy("item_kind", "note_id").orderBy("block", "side")).alias("run"))
    runs = edges.join(numbered, ["item_kind", "note_id", "block", "side"]).groupBy("item_kind", "note_id", "run").applyInPandas(_joined(sizes), PIECES)
    return done.unionByName(runs)


def split_report(notes: DataFrame, segments: DataFrame, limits: DataFrame) -> DataFrame:
    """(note_id, item_kind, cut_kind, n_pieces, longest): one row per item that was cut; `inside_word` where a word is whole in no piece."""
    cuts = pieces(notes, segments, limits).groupBy("item_kind", "note_id").agg(F.count("*").alias("n_pieces"), F.max(F.char_length("text")).alias("longest"), F.max(F.col("boundary") == "inside_word").alias("inside"))
    return cuts.select("note_id", "item_kind", F.when(F.col("inside"), "inside_word").otherwise("natural").alias("cut_kind"), "n_pieces", "longest")


def split_check(notes: DataFrame, segments: DataFrame, limits: DataFrame) -> DataFrame:
    """(note_id, item_kind, n_chars, checksum, n_too_long, n_bad_overlap) of the cores of every item that was cut.

    The checksum adds up each character's code times its place (modulo 9973), so it is that of the item if the cores are the item.
    """
    sizes = limits_of(limits)
    rows = pieces(notes, segments, limits)
    size = F.col("core_end") - F.col("core_start")
    of = lambda at: F.create_map(*[x for kind, v in sizes.items() for x in (F.lit(kind), F.lit(v[at]))])[F.col("item_kind")] if sizes else F.lit(0)
    core = F.expr("substring(text, cast(char_length(text) - (core_end - core_start) + 1 as int))")
    places = F.transform(F.split(core, ""), lambda c, i: F.ascii(c).cast("long") * ((F.col("core_start") + i) % 9973 + 1))
    summed = F.aggregate(places, F.lit(0).cast("long"), lambda a, x: a + x)
    lap = F.char_length("text") - size
    return rows.groupBy("note_id", "item_kind").agg(
        F.sum(size).alias("n_chars"), F.sum(summed).alias("checksum"), F.count_if(F.char_length("text") > of(0)).alias("n_too_long"), F.count_if(lap != F.least(of(1), F.col("core_start"))).alias("n_bad_overlap")
    )
