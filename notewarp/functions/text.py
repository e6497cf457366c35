"""Text functions: normal forms, tokens, query phrases, snippets."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters and digits of any script; everything else separates.
TOKEN_PATTERN = r"[\p{L}\p{N}]+"
#: Words of at least this length count in overlaps.
OVERLAP_LENGTH = 3


def fold_spaces(text: str) -> str:
    return " ".join(text.split())


@F.pandas_udf(T.StringType())
def normalize_text(text: pd.Series) -> pd.Series:
    """Stored form of a name: compatibility composition, full case folding, single spaces. Null stays null."""
    return text.map(lambda t: None if t is None else fold_spaces(unicodedata.normalize("NFKC", t).casefold()))


@F.pandas_udf(T.StringType())
def normalize_query(text: pd.Series) -> pd.Series:
    """Form in which query and title are compared: case folding and single spaces, no composition. Null stays null."""
    return text.map(lambda t: None if t is None else fold_spaces(t.casefold()))


def squeeze(text: Column) -> Column:
    """Lower case and single spaces inside the JVM: equals the two above on plain text."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def _bare_letters() -> dict[str, str]:
    """Letters that are one letter and marks -> that letter, for scripts below U+2000; by rule from the character tables."""
    found = {}
    for point in range(0xC0, 0x2000):
        apart = unicodedata.normalize("NFD", chr(point))
        if len(apart) > 1 and all(unicodedata.combining(c) for c in apart[1:]) and apart[0].isalpha():
            found[chr(point)] = apart[0]
    return found


_BARE = _bare_letters()
_BARE_TABLE = str.maketrans(_BARE)
_MARKS = "\u0300-\u036f"


def bare(text: Column) -> Column:
    """Lower case without diacritics, inside the JVM; null stays null."""
    lowered = F.regexp_replace(F.lower(text), f"[{_MARKS}]", "")
    return F.translate(lowered, "".join(_BARE), "".join(_BARE.values()))


def tokens(text: Column) -> Column:
    """Lower-case tokens without diacritics, inside the JVM; null is an empty array. Texts and queries share this form."""
    return F.coalesce(F.regexp_extract_all(bare(text), F.lit(f"({TOKEN_PATTERN})"), F.lit(1)), F.array().cast("array<string>"))


def index_tokens(text: str) -> list[tuple[str, int, int]]:
    """(token, start, end): the tokens of `tokens` with their places in the text."""
    found = []
    for m in re.finditer(rf"(?:[^\W_][{_MARKS}]*)+", text):
        found.append((re.sub(f"[{_MARKS}]", "", m.group().lower()).translate(_BARE_TABLE), m.start(), m.end()))
    return found


def query_phrases(query: str) -> list[list[str]] | None:
    """A query's phrases: every word between blanks is one, of adjacent tokens. None if the query can match nothing.

    All phrases must match. A word without letters or digits makes the whole query match nothing.
    """
    phrases = [[t for t, _, _ in index_tokens(word)] for word in query.split()]
    if not phrases or not all(phrases):
        return None
    return phrases


def match_expression(query: str) -> str:
    """The query as quoted words joined with AND, embedded quotes doubled."""
    return " AND ".join('"' + word.replace('"', '""') + '"' for word in query.split())


def overlap_words(text: Column) -> Column:
    """Distinct words (letters, digits, `_`) of at least OVERLAP_LENGTH."""
    words = F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)), F.array().cast("array<string>"))
    return F.array_distinct(F.filter(words, lambda t: F.char_length(t) >= OVERLAP_LENGTH))


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def snippet_of(text: str, phrases: list[list[str]], *, size: int = 24, opening: str = "[", closing: str = "]", gap: str = "…") -> str:
    """The stretch of `size` tokens that shows most of the phrases, matches marked, cut ends marked with `gap`.

    A stretch scores 1000 for every phrase it has and 1 for every further match; it is centred on its matches. A stretch that
    begins with a sentence scores 100 more, 120 at the beginning of the text.
    """
    toks = index_tokens(text)
    words = [t for t, _, _ in toks]
    hits = sorted((i, p, len(ph)) for p, ph in enumerate(phrases) for i in range(len(words) - len(ph) + 1) if words[i : i + len(ph)] == ph)
    if not hits:
        return text if len(toks) <= size else text[: toks[size][1]].rstrip() + gap
    n = len(words)

    def score(start: int) -> tuple[int, int]:
        seen: set[int] = set()
        total, first, last = 0, -1, 0
        for at, p, length in hits:
            if start <= at < start + size:
                total += 1 if p in seen else 1000
                seen.add(p)
                first = at if first < 0 else first
                last = at + length
        begin = first - (size - (last - first)) // 2
        return total, max(0, min(begin, n - size))

    sentences = [0] + [i for i in range(1, n) if re.search(r"[.:]\s*$", text[toks[i - 1][2] : toks[i][1]].rstrip("\"'([ \n\t")) or re.search(r"[.:]", text[toks[i - 1][2] : toks[i][1]])]
    best, start = 0, 0
    for at, _, _ in hits:
        got, centred = score(at)
        if got > best:
            best, start = got, centred
        if n > size:
            opener = max(s for s in sentences if s <= at)
            if opener < at:
                got = score(opener)[0] + (120 if opener == 0 else 100)
                if got > best:
                    best, start = got, opener
    end = min(n, start + size)
    marked, at = [], 0 if start == 0 else toks[start][1]
    i = start
    spans: list[tuple[int, int]] = []
    for h, _, length in hits:
        if start <= h < end:
            if spans and h < spans[-1][1]:
                spans[-1] = (spans[-1][0], max(spans[-1][1], h + length))
            else:
                spans.append((h, h + length))
    for h, stop in spans:
        stop = min(stop, n)
        marked += [text[at : toks[h][1]], opening, text[toks[h][1] : toks[stop - 1][2]], closing]
        at = toks[stop - 1][2]
        i = stop
    tail = text[at:] if end == n else text[at : toks[max(end, i) - 1][2]]
    return ("" if start == 0 else gap) + "".join(marked) + tail + ("" if end == n else gap)


def snippet(phrases: list[list[str]], *, size: int = 24):
    """A column function: `snippet_of` of each text; use it on the rows that are left after the limit."""

    @F.pandas_udf(T.StringType())
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else snippet_of(t, phrases, size=size))

    return run
