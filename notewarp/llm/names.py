"""How people write a person's name: parts, folding, edit distance."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

# Letters that do not decompose, titles and endings that are no part of a name.
_PLAIN = str.maketrans({"ł": "l", "ø": "o", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i"})
TITLES = {"dr", "prof", "mr", "mrs", "ms", "miss", "herr", "frau", "m", "mme", "mlle", "sr", "sra", "srta", "don", "doña", "ing", "dipl", "phd", "jr", "md", "mba"}
_TAIL = re.compile(r"\s*(?:\([^)]*\)|\[[^\]]*\]|\s-\s*\w+|,\s*(?:guest|phd|md|mba|jr\.?|external|remote))\s*$", re.I)


def folded(text: str) -> str:
    """Lower case without diacritics."""
    text = unicodedata.normalize("NFKD", text.casefold().translate(_PLAIN))
    return "".join(c for c in text if not unicodedata.combining(c))


def distance(a: str, b: str, most: int = 2) -> int:
    """Edits (insert, delete, replace, swap of neighbours) between a and b; `most` + 1 if there are more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    if len(a) > 6:
        # letters that one has and the other hasn't are edits at least
        ours, theirs = Counter(a), Counter(b)
        if max((ours - theirs).total(), (theirs - ours).total()) > most:
            return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            cost = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if before and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before[j - 2] + 1)
            new.append(cost)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return min(row[-1], most + 1)


def parts(name: str) -> tuple[str, ...]:
    """Folded parts, given name first where the spelling shows it; an initial is a single letter."""
    text = name.replace(" ", " ").strip().strip(":").strip()
    while (short := _TAIL.sub("", text)) != text and short:
        text = short
    text = folded(text)
    if "," in text:
        last, _, first = text.partition(",")
        text = f"{first} {last}"
    if " " not in text.strip() and re.fullmatch(r"[^\W\d_]{2,}(?:-[^\W\d_]+)?[._][^\W\d_]{2,}", text.strip()):
        text = re.sub(r"[._]", " ", text)
    words = [w.strip(".,;:'’()[]") for w in re.split(r"[\s.]+", text)]
    return tuple(w for w in words if w and w not in TITLES)
