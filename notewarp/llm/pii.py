"""Personal information inside free text: found by bootstrapped contextual extraction, replaced by typed placeholders.

1. Candidates: spans that have the shape of an address of e-mail, a number, a street address or a person's name, each with the words
   before and after it. Written-out and obscured forms have shapes too ("five five five zero", "x [at] y dot z"), and so have spans that
   no fixed shape names: unknown capitalised words, numbers beside capitalised words, "x at y.z".
2. Seeds: shapes that belong to one type only, and people named in the structured columns (owners, attendees, speakers).
3. Spark scores the graph of patterns (contexts) and instances (shapes, names, domains, street words) in rounds: a pattern's score for a
   type is the share of its occurrences whose instance is of that type, an instance's score comes from the patterns it is seen in.
   Patterns of high confidence then type the instances that no seed names.
4. A candidate's type is that for which its context, or what the patterns say of its instance, is sure (`decided_by` pattern); where the
   patterns are not sure, the seed's type is taken (`decided_by` seed). Words that are also ordinary words ("rose", "mark") and
   candidates without a seed need the patterns. `holdout` hides a part of the seeds, so that one can measure what the patterns find alone.

Given names are sent to tasks where there are at most MAX_SENT; where there are more, each text is joined with those of its own words that
are given names, with the same result. Common words are those above COMMON_RATE, at most 1 / COMMON_RATE of them. Scores are joined,
never sent.

Defined results: null and empty texts have no spans; rows with a null id keep it; repeated rows are reported once each; texts of any length
are read whole, and no pattern looks further than a fixed window; positions count code points.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewarp.llm.names import folded, parts
from notewarp.llm.turns import FILLERS
from notewarp.session import cut

#: Given names that are sent to every task (some 100 bytes each); more are joined.
MAX_SENT = 100_000
COMMON_RATE = 1e-4
ROUNDS = 2
#: Score from which a context types an instance, and from which an instance without a seed counts.
PATTERN_SCORE, INSTANCE_SCORE = 0.5, 0.5
#: Share of an instance's evidence that must be for one type.
AGREEMENT = 0.8
TYPES = ("id_number", "phone", "name", "email", "address")
#: Score that the context of an ambiguous name must reach, and that of a candidate which neither a seed nor a dictionary knows.
AMBIGUOUS_CONTEXT, UNKNOWN_CONTEXT = 0.5, 0.8

# Titles before names, digits as words, words for `dot`, `at` and `dash`, words and endings of streets.
NAME_TITLES = "dr prof mr mrs ms mx miss herr herrn frau monsieur madame mme mlle señor señora sr sra srta don doña".split()
DIGITS = (
    "zero oh one two three four five six seven eight nine null eins zwo zwei drei vier fünf sechs sieben acht neun "
    "zéro un deux trois quatre cinq sept huit neuf cero uno dos tres cuatro cinco seis siete ocho nueve six double triple"
).split()
DOT, AT, DASH = "dot|punkt|punto|point", "at|arobase|arroba|ät|klammeraffe|chez|bei", "dash|minus|guion|guión|tiret|strich|bindestrich|hyphen"
STREET_WORDS = "street st road rd avenue ave lane ln drive boulevard blvd square court place terrace crescent close"
STREET_BEFORE = "rue avenue av bd boulevard place allée chemin impasse quai calle c/ avda avenida paseo plaza camino carrer"
STREET_ENDINGS = "straße strasse str weg platz gasse allee ring damm ufer"

_HESITATION = re.compile(rf"(?<![\w-])(?:{'|'.join(sorted(FILLERS.split(), key=len, reverse=True))})(?![\w-])(?:\s*(?:\.{{2,}}|…)|[,.])?")
_AT_SIGN = re.compile(r"\s?(?:@|[\[(]\s*(?:at|arobase|arroba|ät)\s*[\])])\s?", re.I)
_LOCAL = re.compile(rf"(?:[\w+\-]+(?:\.|\s?[\[(]\s*(?:{DOT})\s*[\])]\s?))*[\w+\-]+$", re.I)
_DOMAIN = re.compile(rf"[\w\-]+(?:(?:\.|\s?[\[(]\s*(?:{DOT})\s*[\])]\s?)[\w\-]+)+", re.I)
_SPOKEN = re.compile(
    rf"(?<!\w)[a-z0-9]{{1,30}}(?:\s(?:{DOT}|{DASH}|plus|underscore)\s[a-z0-9]{{1,30}}){{0,4}}\s(?:{AT})\s[a-z0-9]{{1,30}}(?:\s(?:{DASH})\s[a-z0-9]{{1,30}}){{0,2}}(?:\s(?:{DOT})\s[a-z0-9]{{2,30}}){{1,3}}(?!\w)", re.I
)
_MIXED = re.compile(rf"(?<![\w.])[\w.+\-]{{2,40}}\s(?:{AT})\s[a-z0-9\-]{{2,40}}(?:\.[a-z0-9\-]{{2,20}}){{1,3}}(?![\w@])", re.I)
_AT_SET, _DOT_SET = frozenset(AT.split("|")), frozenset(DOT.split("|"))
_NUMBER = re.compile(r"(?<![\w.,/+\-])(?:\+\d|\(\d|\d)[\d .()/\-]{5,24}\d(?:-?[A-Z])?(?!\w|[.,/\-]\d)")
_CODE = re.compile(r"(?<![\w\-])(?:[A-Z]{1,2}\d[A-Z0-9]{6,12}|[A-Z]\d{2}(?: \d{3}){2}|[A-Z]{2}(?: \d{2}){3} [A-Z]|[A-Z]\d{7,8}[A-Z]?)(?![\w\-])")
_WORDS = re.compile(rf"(?<!\w)(?:{'|'.join(sorted(set(DIGITS), key=len, reverse=True))})(?:[\s,\-]+(?:{'|'.join(sorted(set(DIGITS), key=len, reverse=True))})(?!\w)){{5,24}}", re.I)
_FILLER_SET = frozenset(FILLERS.split())
_DIGIT = re.compile(r"\d")
_DIGIT_SET = frozenset(DIGITS)
_TITLE_SET = frozenset(NAME_TITLES)
_DATE = re.compile(r"\d{4}-\d{2}-\d{2}|\d{1,2}[./]\d{1,2}[./]\d{2,4}")
_UNIT = r"(?:(?:unit|flat|apt\.?|apartment|suite|wohnung|appartement|piso)\s\w{1,5},\s)?"
_NAME_WORD = r"[A-ZÀ-Þ][\w’'\-]*"
_STREETS = [
    re.compile(rf"(?<![\w])(?i:{_UNIT})\d{{1,5}}[A-Za-z]?,?\s(?:{_NAME_WORD}\s){{1,3}}(?i:{'|'.join(STREET_WORDS.split())})(?![\w])\.?"),
    re.compile(rf"(?<![\w])(?i:{_UNIT})\d{{1,5}}(?:\s?(?:bis|ter|[A-Za-z]))?,?\s(?i:{'|'.join(map(re.escape, STREET_BEFORE.split()))})\.?\s(?:d[eu]\s|de la\s|des\s|d['’])?{_NAME_WORD}"),
    re.compile(rf"(?<![\w])(?i:{'|'.join(map(re.escape, STREET_BEFORE.split()))})\.?\s(?:(?i:de|del|de la|du|des)\s)?{_NAME_WORD}(?:\s{_NAME_WORD}){{0,2}},?\s(?:n[.º°o]*\s?)?\d{{1,5}}"),
    re.compile(rf"(?<![\w])(?:(?:Am|An der|Im|Zum|Zur|Auf der|In der)\s)?[A-ZÄÖÜ][\wäöüß\-]*(?:{'|'.join(STREET_ENDINGS.split())})\.?\s\d{{1,5}}\s?[a-z]?(?!\w)"),
    re.compile(rf"(?<![\w])(?:(?:{_NAME_WORD})\s){{1,2}}(?:Straße|Strasse|Str\.|Weg|Platz|Gasse|Allee)\s\d{{1,5}}[a-z]?"),
]
# words, or endings of words, without which a pattern finds nothing
_BEFORE_WORDS = frozenset(re.sub(r"\W", "", w) for w in STREET_BEFORE.split())
_STREET_HINTS = [frozenset(STREET_WORDS.split()), _BEFORE_WORDS, _BEFORE_WORDS, tuple(STREET_ENDINGS.split()), tuple(STREET_ENDINGS.split())]
# a number beside capitalised words that no street pattern names
_PLACES = [
    re.compile(rf"(?<![\w.,/+\-])\d{{1,5}}[A-Za-z]?,?\s(?:{_NAME_WORD}\s){{1,2}}{_NAME_WORD}(?!\w)"),
    re.compile(rf"(?<!\w)(?:{_NAME_WORD}\s){{1,2}}{_NAME_WORD},?\s\d{{1,4}}[a-z]?(?![\w.,/:\-]\w|\w)"),
]
_MAIL = re.compile(r"\S*@\S*")
_LETTERS_ONLY = re.compile(r"[^\W\d_]+")
_NAME_TOKEN = re.compile(r"[^\W\d_](?:[^\W\d_]|[’'\-](?=[^\W\d_]))*")
_TOKEN = re.compile(r"[^\W\d_][\w’'\-]*\.?|[.,:;!?()\[\]<>\-–—]|\d[\w.,/\-]*|\S")
_LETTERS = re.compile(r"[^\W\d_]")

CANDIDATES = "record_kind string, record_id long, start_pos int, end_pos int, form string, instance string, before string, after string, seed string, plain_word boolean, given_pos int"
COLUMNS = ["record_kind", "record_id", "start_pos", "end_pos", "form", "instance", "before", "after", "seed", "plain_word", "given_pos"]

# Shapes (9 a digit, A a letter) of identity numbers, and of telephone numbers.
ID_SHAPES = [r"A9A9{5}A9", r"A99 999 999", r"AA 99 99 99 A", r"9{8}-?A", r"999-99-9999", r"9 99 99 99 99 999 999", r"99 999 999 999", r"A9{7,8}A?"]
PHONE_SHAPES = [r"\+[9 ().\-/]+", r"\(?0?999?\)?[/ ]9{6,9}", r"9{5} 9{6}", r"9{3}\.9{3}\.9{4}", r"99(?: 99){4}", r"9{7} 9{6}", r"9{4,6}[/ \-]9{5,8}", r"009{3,6} 9{4,8}", r"\(9{3}\) 9{3}-9{4}"]
_ID = re.compile("|".join(f"(?:{s})" for s in ID_SHAPES))
_PHONE = re.compile("|".join(f"(?:{s})" for s in PHONE_SHAPES))


def shape(text: str) -> str:
    """A number's shape: digits are 9, letters A."""
    return re.sub(r"[A-Za-z]", "A", re.sub(r"\d", "9", text))


def lower_words(words: list[str]) -> set[str]:
    """The different words of a text in lower case, parts of joined ones too; what a text can't have without certain words isn't looked for."""
    found = set(map(str.lower, words))
    for joined in [w for w in found if "-" in w]:
        found.update(joined.split("-"))
    return found


def emails(text: str, words: set[str] | None = None) -> list[tuple[int, int]]:
    """Spans of addresses: written, obscured and spoken."""
    found = []
    words = lower_words(_NAME_TOKEN.findall(text)) if words is None else words
    for m in _AT_SIGN.finditer(text) if "@" in text or not words.isdisjoint(_AT_SET) else ():
        lo = max(0, m.start() - 100)
        local, domain = _LOCAL.search(text[lo : m.start()]), _DOMAIN.match(text, m.end(), min(len(text), m.end() + 120))
        if local and domain:
            found.append((lo + local.start(), domain.end()))
    if not words.isdisjoint(_AT_SET) and not words.isdisjoint(_DOT_SET):
        found += [m.span() for m in _SPOKEN.finditer(text)]
    return apart(found)


def apart(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order without overlaps, longer ones first."""
    kept: list[tuple[int, int]] = []
    for s, e in sorted(spans, key=lambda x: (x[0] - x[1], x[0])):
        if all(e <= a or s >= b for a, b in kept):
            kept.append((s, e))
    return sorted(kept)


class Reader:
    """Finds candidates in one text; holds the given names and the common words."""

    def __init__(self, given: set[str], common: set[str]) -> None:
        self.given, self.common = given, common
        self.hesitant = True
        self.memo: dict[str, str] = {}
        self.plainly: dict[str, str] = {}
        self.dull: set[str] = set()
        self.lively: set[str] = set()

    def clean(self, word: str) -> str:
        """A word as names are compared: folded, without a genitive ending."""
        known = self.memo.get(word)
        if known is None:
            known = folded(word)
            known = known[:-2] if known.endswith(("'s", "’s")) else known
            if len(self.memo) < 200_000:
                self.memo[word] = known
        return known

    def fold(self, word: str) -> str:
        known = self.plainly.get(word)
        if known is None:
            known = folded(word)
            if len(self.plainly) < 200_000:
                self.plainly[word] = known
        return known

    def begins_nothing(self, word: str) -> bool:
        """Whether no name can begin with a word: an ordinary word, or one in lower case, that is neither title nor given name nor initial."""
        if word in self.dull:
            return True
        if word in self.lively:
            return False
        upper = word[0].isupper()
        lively = word.lower() in _TITLE_SET or self.clean(word) in self.given or (upper and (len(word) == 1 or self.fold(word) not in self.common))
        kept = self.lively if lively else self.dull
        if len(kept) < 200_000:
            kept.add(word)
        return not lively

    def knowing(self, given: set[str]) -> Reader:
        """This reader with the given names that one text can have."""
        if given != self.given:
            self.given, self.dull, self.lively = given, set(), set()
        return self

    def context(self, text: str, start: int, end: int) -> tuple[str, str]:
        """The three words or marks before and the two after, in lower case, fillers left out, numbers as `#`."""
        window = text[max(0, start - 60) : start].lower()
        left = _TOKEN.findall(_HESITATION.sub(" ", window) if self.hesitant else window)
        if start > 60 and left and not text[start - 61].isspace():
            left = left[1:]
        right = (_TOKEN.findall(text[end : end + 40].lower()) + ["$", "$"])[:2]
        word = lambda t: "#" if t[0].isdigit() else t
        return " ".join(word(t) for t in (["^", "^", *left])[-3:]), " ".join(map(word, right))

    def numbers(self, text: str, taken: list[tuple[int, int]], low: set[str]) -> list[tuple]:
        spans = [m.span() for p in (_CODE, _NUMBER) for m in p.finditer(text)] if _DIGIT.search(text) else []
        if not low.isdisjoint(_DIGIT_SET) and sum(w.lower() in _DIGIT_SET for w in _LETTERS_ONLY.findall(text)) >= 6:
            spans += [m.span() for m in _WORDS.finditer(text)]
        if not spans:
            return []
        out = []
        for s, e in apart([x for x in spans if all(x[1] <= a or x[0] >= b for a, b in taken)]):
            value = text[s:e]
            if value[0].isalpha() and not any(c.isdigit() for c in value):
                form, instance, seed = "digits", "words", ""
            else:
                form, instance = "number", shape(value)
                if _DATE.fullmatch(value) or sum(c.isdigit() for c in value) < 6:
                    continue
                seed = "id_number" if _ID.fullmatch(instance) else "phone" if _PHONE.fullmatch(instance) else ""
            out.append((s, e, form, instance, *self.context(text, s, e), seed, False, -1))
        return out

    def streets(self, text: str, taken: list[tuple[int, int]], low: set[str]) -> list[tuple[int, int]]:
        if not _DIGIT.search(text):
            return []
        patterns = [p for p, words in zip(_STREETS, _STREET_HINTS) if (any(w.endswith(words) for w in low) if isinstance(words, tuple) else not low.isdisjoint(words))]
        spans = [m.span() for p in patterns for m in p.finditer(text)]
        return apart([x for x in spans if all(x[1] <= a or x[0] >= b for a, b in taken)])

    def unseeded(self, text: str, taken: list[tuple[int, int]], low: set[str]) -> list[tuple]:
        """Spans without a fixed shape that a context may name an address of a house or of e-mail."""
        out = []
        if _DIGIT.search(text):
            spans = [m.span() for p in _PLACES for m in p.finditer(text)]
            for s, e in apart([x for x in spans if all(x[1] <= a or x[0] >= b for a, b in taken)]):
                words = [w.group() for w in _NAME_TOKEN.finditer(text, s, e) if len(w.group()) > 1]
                if words and not any(self.clean(w) in self.given for w in words):
                    out.append((s, e, "place", self.clean(words[-1]), *self.context(text, s, e), "", False, -1))
        if "." in text and not low.isdisjoint(_AT_SET):
            for m in _MIXED.finditer(text):
                if all(m.end() <= a or m.start() >= b for a, b in taken):
                    out.append((*m.span(), "mixed", "at", *self.context(text, *m.span()), "", False, -1))
        return out

    def names(self, text: str, taken: list[tuple[int, int]], spelled: list[str]) -> list[tuple]:
        dull, begins_nothing = self.dull, self.begins_nothing
        lively = [i for i, w in enumerate(spelled) if w not in dull and not begins_nothing(w)]
        if not lively:
            return []
        words = list(_NAME_TOKEN.finditer(text))
        out, upto, n, at, blocked = [], 0, len(words), 0, taken
        given, common, clean = self.given, self.common, self.clean

        for i in lively:
            if i < upto:
                continue
            m = words[i]
            raw = m.group()
            s, e = m.span()
            while at < len(blocked) and blocked[at][1] <= s:
                at += 1
            if at < len(blocked) and blocked[at][0] < e:
                continue
            upper, key = raw[0].isupper(), clean(raw)
            plain = raw.lower()
            # a title: the name begins after it
            if plain in _TITLE_SET and i + 1 < n and words[i + 1].start() - e <= 2 and text[e : words[i + 1].start()] in (" ", ". ", "  ", " ", ". ") and (words[i + 1].group()[0].isupper() or clean(words[i + 1].group()) not in common):
                j = i + 1
                end, j = self.extend(text, words, j)
                out.append((words[i + 1].start(), end, "titled", clean(words[j - 1].group()), *self.context(text, s, end), "name", False, -1))
                upto = j
                continue
            # an initial before a surname
            if len(raw) == 1 and upper and i + 1 < n and text[e : e + 1] == "." and text[e + 1 : words[i + 1].start()].strip(" \xa0") == "" and words[i + 1].start() - e <= 3:
                nxt = words[i + 1].group()
                if len(nxt) >= 4 and nxt[0].isupper() and clean(nxt) not in common:
                    end = self.shorten(words[i + 1])
                    out.append((s, end, "initial", clean(nxt), *self.context(text, s, end), "name", False, -1))
                    upto = i + 2
                    continue
            if key in given:
                end, j = self.extend(text, words, i)
                ambiguous = plain in common or not upper
                if j - i > 1 or end > self.shorten(m):
                    form = "full"
                else:
                    form = "given"
                if form == "given" and not upper and plain in common:
                    continue
                if form == "full" and not upper and j - i > 1 and not words[i + 1].group()[0].isupper() and (clean(words[i + 1].group()) in common or len(words[i + 1].group()) < 5):
                    continue
                # a label before a colon needs no other context
                if form == "given" and (upper or plain not in common) and re.match(r"\s*:", text[end : end + 2]) and (not text[:s].strip() or text[:s].rstrip(" ").endswith((">>", "[", "\n", ")", "]", "-")) or text[max(0, s - 6) : s].strip()[-2:].isdigit()):
                    ambiguous = False
                out.append((s, end, form, key if form == "given" else f"{key} *", *self.context(text, s, end), "name", ambiguous and form == "given", -1))
                upto = j
                continue
            # a surname before the given name: with a comma, or in a label; where nobody bears that surname the name begins later
            if self.inverted(text, words, i):
                given_at = words[i + 1]
                label = not text[:s].strip(" >[<\n") or text[:s].rstrip(" ").endswith((">>", "[", "]", "\n", ")", "-"))
                if label and re.match(r"\s*[:\]]|\s-\s|\s\(", text[given_at.end() : given_at.end() + 3]):
                    out.append((s, given_at.end(), "full", f"{clean(given_at.group())} *", *self.context(text, s, given_at.end()), "name", False, -1))
                    upto = i + 2
                    continue
                if "," in text[e : given_at.start()] and self.extend(text, words, i + 1)[1] == i + 2:
                    out.append((s, self.shorten(given_at), "comma", key, *self.context(text, s, given_at.end()), "", False, given_at.start()))
                    upto = i + 2
                    continue
            if upper and len(raw) >= 3 and key not in common and plain not in common:
                end, j = self.shorten(m), i + 1
                follows = words[j].group() if j < n and text[e : words[j].start()] == " " else ""
                if len(follows) > 2 and follows[0].isupper() and clean(follows) not in common and clean(follows) not in given and follows.lower() not in _TITLE_SET and not self.inverted(text, words, j):
                    end, j = self.shorten(words[j]), j + 1
                out.append((s, end, "cap", key, *self.context(text, s, end), "", False, -1))
                upto = j
                continue
        return out

    def inverted(self, text: str, words: list[re.Match], i: int) -> bool:
        """Whether word i is an unknown capitalised word before a given name."""
        if i + 1 >= len(words):
            return False
        word, nxt = words[i].group(), words[i + 1].group()
        nxt = nxt[:-2] if nxt.endswith(("'s", "’s")) else nxt
        gap = text[words[i].end() : words[i + 1].start()]
        return word[0].isupper() and nxt[0].isupper() and len(word) >= 4 and gap in (" ", ", ", "  ", ",  ", "\xa0", ",\xa0") and self.fold(word) not in self.common and self.fold(nxt) in self.given

    @staticmethod
    def shorten(m: re.Match) -> int:
        """End of a word without a genitive ending."""
        return m.end() - 2 if m.group().endswith(("'s", "’s")) else m.end()

    def extend(self, text: str, words: list[re.Match], i: int) -> tuple[int, int]:
        """(end, next word) of a name that begins with word i: an initial, particles and surnames that follow."""
        end, j = self.shorten(words[i]), i + 1
        if end < words[i].end():
            return end, j
        while j < len(words) and j - i < 4:
            gap, w = text[words[j - 1].end() : words[j].start()], words[j].group()
            if gap not in (" ", "  ", " ", ". ") or (gap == ". " and len(words[j - 1].group()) != 1):
                break
            low = self.fold(w[:-2] if w.endswith(("'s", "’s")) else w)
            if len(w) == 1 and w.isupper() and text[words[j].end() : words[j].end() + 1] == ".":
                end, j = words[j].end() + 1, j + 1
                continue
            if low in self.common or low in self.given or len(low) < 4:
                break
            upper = w[0].isupper()
            if not upper and words[i].group()[0].isupper() and not words[i].group().isupper():
                break
            end, j = self.shorten(words[j]), j + 1
            break
        return end, j

    def candidates(self, text: str) -> list[tuple]:
        spelled = _NAME_TOKEN.findall(text)
        low = lower_words(spelled)
        self.hesitant = not low.isdisjoint(_FILLER_SET)
        mails = emails(text, low)
        out = [(s, e, "email", text[s:e].rpartition("@")[2].strip().lower()[:60] or "email", *self.context(text, s, e), "email", False, -1) for s, e in mails]
        places = self.streets(text, mails, low)
        for s, e in places:
            words = [w.group() for w in _NAME_TOKEN.finditer(text, s, e) if len(w.group()) > 1]
            out.append((s, e, "street", self.clean(words[-1]) if words else "street", *self.context(text, s, e), "address", False, -1))
        taken = sorted(mails + places)
        out += self.numbers(text, taken, low)
        out += self.unseeded(text, taken, low)
        return out + self.names(text, taken, spelled)


def _candidates(given: set[str] | None, common: set[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(given or set(), common)
        for pdf in batches:
            # without a set for all, each text brings the given names among its words
            known = [given] * len(pdf) if given is not None else [set(g) for g in pdf["given_here"]]
            rows = [(kind, i, *c) for kind, i, text, g in zip(pdf["record_kind"], pdf["record_id"], pdf["text"], known) for c in reader.knowing(g).candidates(text)]
            yield pd.DataFrame(rows, columns=COLUMNS)

    return run


def _text_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    reader = Reader(set(), set())
    for pdf in batches:
        rows = [(h, w) for h, text in zip(pdf["h"], pdf["text"]) for w in {reader.clean(x) for x in _NAME_TOKEN.findall(text)}]
        yield pd.DataFrame(rows, columns=["h", "given"])


def with_given(texts: DataFrame, given: DataFrame) -> DataFrame:
    """`texts` with given_here: those of a text's words that are given names."""
    hashed = texts.withColumn("h", F.sha2("text", 256))
    words = hashed.select("h", "text").dropDuplicates(["h"]).mapInPandas(_text_words, "h string, given string")
    here = words.join(given.select("given"), "given", "left_semi").groupBy("h").agg(F.collect_set("given").alias("given_here"))
    return hashed.join(here, "h", "left").withColumn("given_here", F.coalesce("given_here", F.array().cast("array<string>"))).drop("h")


def _count_lower(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def flush(total: Counter, size: int) -> pd.DataFrame:
        rows = [(w, n) for w, n in total.items() if w[0].islower() or len(w) < 3]
        return pd.DataFrame([*rows, ("\u0000", size)], columns=["word", "n"])

    total, size = Counter(), 0
    for pdf in batches:
        for text in pdf["text"]:
            total.update(_NAME_TOKEN.findall(_MAIL.sub(" ", text) if "@" in text else text))
            size += 1 + len(text) // 6
        if len(total) > 500_000:
            yield flush(total, size)
            total, size = Counter(), 0
    yield flush(total, size)


def common_words(texts: DataFrame) -> set[str]:
    """Words that stand in lower case at COMMON_RATE or more, over all texts; at most 1 / COMMON_RATE of them."""
    counts = cut(texts.select("text").mapInPandas(_count_lower, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))
    total = counts.filter(F.col("word") == "\u0000").agg(F.sum("n")).first()[0] or 1
    kept = counts.filter(F.col("n") >= F.lit(total * COMMON_RATE)).filter(F.col("word") != "\u0000").select("word").toLocalIterator()
    return {w for r in kept for w in (r.word.lower(), folded(r.word))}


def _given_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for name, n in zip(pdf["name"], pdf["n"]):
            p = parts(name)
            if len(p) >= 2 and len(p[0]) > 1 and len(p[-1]) > 1:
                out += [(p[0], p[-1], n, 0), (p[-1], p[0], 0, n)]
        yield pd.DataFrame(out, columns=["given", "family", "first", "last"])


def people_names(people: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(given) names and (surname)s of the people of the structured columns (name).

    A name is a given name if it stands first oftener than last, and twice or beside a known surname.
    """
    named = people.filter("name is not null and trim(name) <> ''").groupBy("name").agg(F.count("*").alias("n"))
    pairs = cut(named.mapInPandas(_given_of, "given string, family string, first long, last long"))
    each = pairs.groupBy("given").agg(F.sum("first").alias("first"), F.sum("last").alias("last"))
    surnames = cut(each.filter("last >= 2 and last > first and length(given) > 3").select(F.col("given").alias("surname")))
    # a spelling mistake is rare beside the name itself; a surname that somebody put first is last elsewhere
    vouched = pairs.filter("first > 0").join(surnames.withColumnRenamed("surname", "family"), "family", "left_semi").select("given").distinct().withColumn("beside", F.lit(True))
    kept = each.join(vouched, "given", "left").filter("first > last and (first >= 2 or beside)").select("given")
    return cut(kept), surnames


def hidden(instance: F.Column, holdout: float) -> F.Column:
    """Whether an instance is among the share of those whose seeds are withheld."""
    return F.pmod(F.xxhash64(instance, F.lit("held out")), F.lit(1000)) < int(1000 * holdout)


def scored(candidates: DataFrame, surnames: DataFrame, *, holdout: float = 0.0) -> DataFrame:
    """`candidates` with what the patterns say: `i_` of the instance and `p_` of the context, per type, after ROUNDS over the graph."""
    # an edge per (form, instance, context); hot instances and contexts are combined before the shuffle
    number, reach = F.col("form").isin("number", "digits"), F.col("form").isin("email", "street", "place", "mixed")
    family = F.when(number, "number").when(reach, "reach").otherwise("name")
    # numbers and addresses are told by the three or two words before them; names by a word on either side, or by the two after them
    last = lambda n: F.array_join(F.slice(F.split("before", " "), -n, n), " ")
    near = F.when(number | reach, F.col("before")).otherwise(F.concat_ws(" _ ", last(1), F.element_at(F.split("after", " "), 1)))
    far = F.when(number | reach, last(2)).otherwise(F.concat_ws(" ", F.lit("_"), "after"))
    shaped = ~F.col("plain_word") & (F.col("seed") != "")
    seeded = F.when(shaped & ~hidden(F.col("instance"), holdout), F.col("seed"))
    edges = cut(
        candidates.select(family.alias("family"), "instance", shaped.alias("shaped"), seeded.alias("seed"), F.explode(F.array(F.concat(F.lit("1 "), near), F.concat(F.lit("2 "), far))).alias("pattern"))
        .groupBy("family", "instance", "pattern")
        .agg(F.count("*").alias("n"), F.count_if("shaped").alias("n_shaped"), F.count("seed").alias("n_seed"), F.max("seed").alias("seed"))
    )
    # an instance is a seed where most of its occurrences are, or where a structured column has it as a surname
    instances = edges.groupBy("family", "instance").agg(F.max("seed").alias("seed"), (F.sum("n_seed") / F.sum("n")).alias("share"))
    known = surnames.select(F.lit("name").alias("family"), F.col("surname").alias("instance"), F.lit("name").alias("is_surname")).filter(~hidden(F.col("instance"), holdout))
    instances = cut(instances.join(known, ["family", "instance"], "left").select("family", "instance", F.coalesce("is_surname", F.when(F.col("share") >= 0.5, F.col("seed"))).alias("seed")))
    types = F.when(F.col("seed").isNotNull(), F.map_from_arrays(F.array("seed"), F.array(F.lit(1.0)))).otherwise(F.create_map().cast("map<string,double>"))
    inst = instances.select("family", "instance", "seed", *[F.coalesce(types[t], F.lit(0.0)).alias(t) for t in TYPES])
    for _ in range(ROUNDS):
        weighed = edges.select("family", "instance", "pattern", "n", "n_shaped").join(inst, ["family", "instance"])
        # numbers, and shapes of a type that nothing vouches for, say little against a context; capitalised words that nobody knows say much
        unknown = F.col("n_shaped") * 0.1 + (F.col("n") - F.col("n_shaped")) * F.when(F.col("family") == "number", 0.1).otherwise(1.0)
        against = F.sum(F.when(F.greatest(*TYPES) > 0, F.col("n")).otherwise(unknown)) + 1
        pats = weighed.groupBy("family", "pattern").agg(*[(F.sum(F.col(t) * F.col("n")) / against).alias(f"p_{t}") for t in TYPES])
        pats = cut(pats)
        back = edges.select("family", "instance", "pattern", "n").join(pats, ["family", "pattern"]).groupBy("family", "instance")
        seen = back.agg(*[(F.sum(F.col(f"p_{t}") * F.col("n")) / F.sum("n")).alias(f"i_{t}") for t in TYPES])
        # a seed keeps its type; other instances take the one type their patterns agree on, once that is sure
        best = F.greatest(*[F.col(f"i_{t}") for t in TYPES])
        agreed = best >= AGREEMENT * sum((F.col(f"i_{t}") for t in TYPES), F.lit(0.0))
        told = lambda t: F.when((F.col(f"i_{t}") >= INSTANCE_SCORE) & (F.col(f"i_{t}") == best) & agreed, F.col(f"i_{t}")).otherwise(0.0)
        own = lambda t: F.when(F.col("seed") == t, 1.0).when(F.col("seed").isNotNull(), 0.0).otherwise(told(t))
        inst = cut(instances.join(seen, ["family", "instance"]).select("family", "instance", "seed", *[own(t).alias(t) for t in TYPES], *[told(t).alias(f"told_{t}") for t in TYPES]))
    named = candidates.withColumn("family", family).withColumn("near", F.concat(F.lit("1 "), near)).withColumn("far", F.concat(F.lit("2 "), far))
    scores = inst.select("family", "instance", *[F.col(t).alias(f"i_{t}") for t in TYPES], *[F.col(f"told_{t}").alias(f"t_{t}") for t in TYPES])
    one = pats.select("family", F.col("pattern").alias("near"), *[F.col(f"p_{t}").alias(f"near_{t}") for t in TYPES])
    two = pats.select("family", F.col("pattern").alias("far"), *[F.col(f"p_{t}").alias(f"far_{t}") for t in TYPES])
    joined = named.join(scores, ["family", "instance"], "left").join(one, ["family", "near"], "left").join(two, ["family", "far"], "left")
    # of a number's contexts the longer one decides where it is sure; of a name's the better one
    sure = F.greatest(*[f"near_{t}" for t in TYPES]) >= PATTERN_SCORE
    score = lambda t: F.when(F.col("family") == "name", F.greatest(f"near_{t}", f"far_{t}")).when(sure, F.col(f"near_{t}")).otherwise(F.col(f"far_{t}"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return joined.select(*COLUMNS, *[zero(F.col(f"{k}_{t}")).alias(f"{k}_{t}") for k in ("i", "t") for t in TYPES], *[zero(score(t)).alias(f"p_{t}") for t in TYPES])


def typed_spans(texts: DataFrame, people: DataFrame, *, holdout: float = 0.0) -> DataFrame:
    """(record_kind, record_id, pii_type, start_pos, end_pos, decided_by, withheld) of all personal information.

    `texts` is (record_kind, record_id, text), `people` (name). `withheld`: the instance's seed was hidden, so that only patterns count.
    """
    texts = texts.filter("text is not null and text <> ''")
    common = common_words(texts)
    given, surnames = people_names(people)
    if given.limit(MAX_SENT + 1).count() <= MAX_SENT:
        found = texts.mapInPandas(_candidates({r.given for r in given.toLocalIterator()}, common), CANDIDATES)
    else:
        found = with_given(texts, given).mapInPandas(_candidates(None, common), CANDIDATES)
    rated = scored(cut(found), surnames, holdout=holdout).withColumn("withheld", (F.col("seed") != "") & hidden(F.col("instance"), holdout))
    p, i, t = (lambda k, key=key: F.col(f"{key}_{k}") for key in ("p", "i", "t"))
    form = lambda *f: F.col("form").isin(*f)
    # what the patterns say: the context where it is sure, else all contexts of the instance
    by_context = F.when((p("id_number") >= PATTERN_SCORE) & (p("id_number") > p("phone")), "id_number").when(p("phone") >= PATTERN_SCORE, "phone")
    by_instance = F.when(t("id_number") > 0, "id_number").when(t("phone") > 0, "phone")
    unknown = lambda k: (p(k) >= UNKNOWN_CONTEXT) & (i(k) >= INSTANCE_SCORE)
    name = F.greatest(p("name"), t("name"))
    pattern = (
        F.when(form("number"), F.coalesce(by_context, F.when((F.col("seed") != "") | F.col("withheld"), by_instance)))
        .when(form("digits"), by_context)
        .when(form("email") & (F.greatest(p("email"), t("email")) >= PATTERN_SCORE), "email")
        .when(form("street") & (F.greatest(p("address"), t("address")) >= PATTERN_SCORE), "address")
        .when(form("place") & unknown("address"), "address")
        .when(form("mixed") & unknown("email"), "email")
        .when(form("full", "titled") & (name >= PATTERN_SCORE), "name")
        .when(form("comma") & (name >= PATTERN_SCORE), "name")
        .when(form("initial") & (t("name") >= INSTANCE_SCORE), "name")
        .when(form("given") & F.when(F.col("plain_word"), p("name") >= AMBIGUOUS_CONTEXT).otherwise(name >= PATTERN_SCORE), "name")
        .when(form("cap") & unknown("name"), "name")
    )
    # where the patterns aren't sure: the type of the seed
    seed = (
        F.when(form("number", "email", "street") & (F.col("seed") != ""), F.col("seed"))
        .when(form("full", "titled", "comma") | (form("given") & ~F.col("plain_word")), "name")
        .when(form("initial") & (i("name") >= INSTANCE_SCORE), "name")
    )
    kind = F.coalesce(pattern, F.when(~F.col("withheld"), seed))
    start = F.when(form("comma") & (i("name") < INSTANCE_SCORE), F.col("given_pos")).otherwise(F.col("start_pos"))
    typed = rated.withColumn("pii_type", kind).filter("pii_type is not null")
    return typed.select("record_kind", "record_id", "pii_type", start.alias("start_pos"), "end_pos", F.when(pattern.isNotNull(), "pattern").otherwise("seed").alias("decided_by"), "withheld")


def spans(texts: DataFrame, people: DataFrame) -> DataFrame:
    """(record_kind, record_id, pii_type, start_pos, end_pos) of all personal information."""
    return typed_spans(texts, people).drop("decided_by", "withheld")


def free_texts(notes: DataFrame, segments: DataFrame, citations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(record_kind, record_id, text) of the three tables, and (name) of everybody their structured columns name."""
    texts = (
        notes.select(F.lit("summary").alias("record_kind"), F.col("detail_no").alias("record_id"), F.col("summary_text").alias("text"))
        .unionByName(segments.select(F.lit("segment").alias("record_kind"), F.col("segment_id").alias("record_id"), "text"))
        .unionByName(citations.select(F.lit("citation").alias("record_kind"), F.col("citation_no").alias("record_id"), F.col("excerpt").alias("text")))
    )
    people = (
        notes.select(F.col("owner.name").alias("name"))
        .unionByName(notes.select(F.explode("attendees").alias("a")).select(F.col("a.name").alias("name")))
        .unionByName(segments.select(F.col("speaker.name").alias("name")))
        .unionByName(citations.select(F.col("speaker_name").alias("name")))
    )
    return texts, people


#: Placeholders by type.
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}


def replaced(text: str, found: list[tuple[int, int, str]]) -> str:
    """`text` with each span replaced by its placeholder; the rest is unchanged."""
    out, at = [], 0
    for start, end, kind in sorted(found):
        if start >= at:
            out += [text[at:start], PLACEHOLDERS[kind]]
            at = end
    return "".join([*out, text[at:]])


def _replace(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        made = [t if t is None or f is None else replaced(t, [(x["start_pos"], x["end_pos"], x["pii_type"]) for x in f]) for t, f in zip(pdf["text"], pdf["found"])]
        yield pd.DataFrame({"record_kind": pdf["record_kind"], "record_id": pdf["record_id"], "text": made})


def redacted(texts: DataFrame, people: DataFrame) -> DataFrame:
    """(record_kind, record_id, text) with placeholders; ids are taken to be unique within a kind."""
    per_text = spans(texts, people).groupBy("record_kind", "record_id").agg(F.collect_list(F.struct("start_pos", "end_pos", "pii_type")).alias("found"))
    return texts.join(per_text, ["record_kind", "record_id"], "left").select("record_kind", "record_id", "text", "found").mapInPandas(_replace, "record_kind string, record_id long, text string")
