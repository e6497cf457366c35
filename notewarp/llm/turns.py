"""Speech transcripts into clean, ordered speaker turns.

1. Rows of a note with the same start and the same text apart from case and white space are one segment (smallest id).
2. Leading timestamps, sound annotations and fillers are taken off, a speaker written before the text is read, and segments
   without speech are dropped.
3. Per note the distinct spellings of labels and names become voices: spellings of one name are clustered, and a label and a
   name on one segment are joined. Only distinct spellings are grouped, never segments.
4. A hidden Markov speaker model of the note decides what spellings leave open; what has one possible voice gets that voice and serves
   the model as an observation. Transitions are those counted between neighbours, smoothed; emissions are each participant's language
   profile (language, fillers, sentence form, length) and whether a label, a name or both are written.
   a. A label that is never written with a name, and a person never written with a label, may be one voice: the likelihoods of the
      note with both as one voice and as two are compared (`links_of`).
   b. A segment without a label may be any of several people on the microphone (persons, or labels where nobody is named). Known voices
      pin the chain, so every stretch between two pins is decoded by itself (Viterbi). A stretch of more than BLOCK segments is
      cut into parts; each part gives the best score from every first to every last state, those are put together, and each part is
      then decoded between the states that the best path has at its ends: the result is that of the whole stretch.
5. Segments are put in order of (start_time, segment_id) and runs of one voice become turns.

Defined results: null text is empty text; null note ids are ignored; a null start sorts last; ties in start_time go by segment_id;
empty tables give empty results; very long texts are read whole; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from math import exp, lgamma, log
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from notewarp.llm.names import distance, parts
from notewarp.operators.ordered import numbered_runs, with_previous
from notewarp.session import cut, cut_counted

#: Seconds of one window bucket.
BUCKET_S = 600
#: Ids that differ in these bits only share a bucket where there is no time.
UNTIMED_BITS = 14
#: Unlabelled segments decoded together.
BLOCK = 2000
#: Weight, in transitions, of what holds for the whole note in a voice's own transitions; added count of a trait; score of the impossible.
SMOOTHING, TRAIT_COUNT, NEVER = 4.0, 0.5, -1e9
#: Probability that a voice is never named, or never labelled, in a note that writes labels and names together.
BARE_VOICE = 0.05
#: A label and a name that never meet are joined if the note is more than this many times as likely with one voice.
LIKELIER = 2.0

# Fillers and words that give a language away.
FILLERS = "mm-hmm mhm uh-huh uh um er erm hmm hm ah äh ähm öhm euh heu hum eh em ehm"
LANGUAGE_WORDS = {
    "en": "the and of to is that for it we was not with you i in on are have be".split(),
    "de": "der die das und ist nicht wir ich zu für mit ein eine den auf war es wer".split(),
    "fr": "le la les et est pas nous je pour avec un une des de que sur qui on".split(),
    "es": "el la los y es no por para con una un las de que en se lo al".split(),
}
# Words before a colon that are no speaker.
NO_SPEAKER = frozenset("action note question decision risk todo thanks danke merci gracias okay well so und et y".split())
_LANGUAGE = {lang: frozenset(words) for lang, words in LANGUAGE_WORDS.items()}

_TIME = r"\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d{1,3})?"
_FILLER = "(?:" + "|".join(sorted(FILLERS.split(), key=len, reverse=True)) + r")(?![\w-])(?:\s*(?:\.{2,}|…)|[,.!?])?"
_SOUND = (
    r"(?:\[\s*(?:music|laughter|laughs?|laughing|crosstalk|noise|applause|silence|pause|inaudible[^\]]*|unintelligible[^\]]*|blank_audio|cough\w*)\s*\]"
    r"|\(\s*(?:laughs?|laughter|laughing|phone ringing|inaudible[^)]*|crosstalk|music|applause|pause|cough\w*|noise)\s*\)"
    r"|<\s*(?:noise|music|laughter|crosstalk|pause|inaudible[^>]*)\s*>|\{\s*(?:pause|music|noise|laughter|crosstalk|inaudible[^}]*)\s*\}|\*\s*(?:coughs?|laughs?|sighs?|sneezes?|noise)\s*\*|[♪♫]+)"
)
_LEAD = re.compile(rf"^(?:\s|[\[(]{_TIME}[\])]\s*-?|{_TIME}\s*(?:-(?=\s))?|{_SOUND}[.,]?|{_FILLER}|[-–—•.,…]+(?=\s|$))+", re.I)
_LABEL = r"(?:speaker|spk|sprecher|locuteur|hablante)[\s_\-]*[a-z0-9]{1,3}"
_WORD = r"[^\W\d_][\w’'\-]*\.?"
_PERSON = rf"(?:{_WORD}(?:,?[  ]+{_WORD}){{0,3}}|[^\W\d_]+\.[^\W\d_]+)(?:\s*(?:\([^)\d]*\)|\[[^\]\d]*\]|-\s+guest))?"
_STAMP = rf"(?:\s*[\[(]{_TIME}[\])])?"
_PREFIX = re.compile(
    rf"^(?:>>\s*(?P<a>{_LABEL}|{_PERSON}){_STAMP}\s*:|\[\s*(?P<b>{_LABEL}|{_PERSON})\s*\]:?|<\s*(?P<c>{_LABEL}|{_PERSON})\s*>:?|(?P<d>{_LABEL}){_STAMP}\s*(?::|-(?=\s))|(?P<e>{_PERSON}){_STAMP}(?:\s*:(?!//)|\s+-(?=\s)))\s*", re.I
)
_INSIDE_TIME = re.compile(rf"[\[(]{_TIME}[\])]")
_INSIDE_SOUND = re.compile(_SOUND, re.I)
_INSIDE_FILLER = re.compile(rf"(?<![\w-]){_FILLER}", re.I)
_SPEECH = re.compile(r"\w")
_WORD_LIST = re.compile(r"[^\W\d_]{2,}")
_NO_SPEECH = frozenset(FILLERS.replace("-", " ").split()) | frozenset("music laughter laugh laughs laughing crosstalk noise applause silence pause inaudible unintelligible blank audio cough coughs coughing phone ringing sigh sighs sneeze sneezes".split())
_NUMBER = re.compile(_LABEL.replace("[a-z0-9]{1,3}", "([a-z0-9]{1,3})") + r"\s*:?\s*|([a-z0-9]{1,3})\s*:?\s*", re.I)

PARSED = "segment_id long, note_id string, source string, start_time timestamp, end_time timestamp, label string, name string, spoken string, profile string"


def label_key(label: str | None) -> str | None:
    """Speaker 3, spk_3, SPEAKER-3: and 3 are one label; null if blank."""
    label = (label or "").strip()
    if not label:
        return None
    m = _NUMBER.fullmatch(label)
    key = (m.group(1) or m.group(2)) if m else label
    return key.casefold().lstrip("0") or "0"


def language_of(text: str) -> str:
    words = re.findall(r"\w+", text.casefold())
    hits = {lang: sum(w in known for w in words) for lang, known in _LANGUAGE.items()}
    best = max(hits, key=hits.get)
    return best if hits[best] else "?"


def without_lead(text: str) -> str:
    """Text without timestamps, annotations, fillers and marks at its beginning."""
    m = _LEAD.match(text)
    return text[m.end() :] if m else text


def read_prefix(text: str, *, known_speaker: bool) -> tuple[str | None, str | None, str]:
    """(label, name, rest) of a text whose leading decoration is taken off; nothing is read where the fields name the speaker."""
    rest = without_lead(text)
    if known_speaker:
        return None, None, rest
    m = _PREFIX.match(rest)
    if not m:
        return None, None, rest
    which, value = next((k, v) for k, v in m.groupdict().items() if v)
    if re.fullmatch(_LABEL, value, re.I):
        return value, None, without_lead(rest[m.end() :])
    if which == "e":
        words = re.split(r"[\s,]+", re.sub(r"\s*(?:\(.*\)|\[.*\]|-\s+guest)$", "", value, flags=re.I).strip())
        initial = re.match(r"[^\W\d_]\.\s", value)
        dash = not m.group().rstrip().endswith(":")
        # a dash follows an initial and a surname only: before it stand also words like "agreed"
        if dash and not initial:
            return None, None, rest
        shaped = initial or all(w[0].isupper() for w in words) or len(words) <= 2
        if not shaped or len(words) > 3 or words[0].casefold() in NO_SPEAKER:
            return None, None, rest
    return None, value, without_lead(rest[m.end() :])


def clean_text(text: str) -> str:
    """Text without timestamps in brackets, sound annotations and fillers; white space collapsed."""
    german = language_of(text) == "de"
    text = _INSIDE_SOUND.sub(" ", _INSIDE_TIME.sub(" ", text))

    def filler(m: re.Match) -> str:
        # `um` and `er` are words in German
        plain = re.fullmatch(r"(?:um|er|eh|em|hum)", m.group(), re.I)
        return m.group() if german and plain else " "

    text = _INSIDE_FILLER.sub(filler, text)
    return re.sub(r"\s+([.,!?])", r"\1", " ".join(text.split())).strip(" ,")


def has_speech(rest: str) -> bool:
    """Whether anything but fillers, annotations, timestamps and punctuation is left."""
    # a word that is no filler, and that no annotation has, settles it
    if any(w not in _NO_SPEECH for w in _WORD_LIST.findall(rest[:400].lower())):
        return True
    left = _INSIDE_SOUND.sub(" ", rest)
    left = re.sub(rf"(?<!\d){_TIME}(?!\d)", " ", left)
    return bool(_SPEECH.search(_INSIDE_FILLER.sub(" ", left)))


def profile_of(spoken: str) -> str:
    """Coarse traits of one utterance: language, fillers, first letter, end, length."""
    end = spoken.rstrip()[-1:]
    return "|".join(("l" + language_of(spoken), "f" + str(bool(_INSIDE_FILLER.search(spoken)))[0], "u" + str(spoken[:1].isupper())[0], "e" + (end if end in ".?!" and end else "-"), "n" + str(min(4, len(spoken) // 30))))


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for row in pdf.itertuples(index=False):
            raw = row.text or ""
            label, name = (row.label or "").strip() or None, (row.name or "").strip() or None
            in_label, in_name, rest = read_prefix(raw, known_speaker=bool(label or name))
            if not has_speech(rest):
                continue
            out.append((row.segment_id, row.note_id, row.source, row.start_time, row.end_time, label_key(label or in_label), name or in_name, rest, profile_of(rest)))
        yield pd.DataFrame(out, columns=["segment_id", "note_id", "source", "start_time", "end_time", "label", "name", "spoken", "profile"])


@F.pandas_udf(T.StringType())
def _clean(spoken: pd.Series) -> pd.Series:
    return spoken.map(clean_text)


def distinct_segments(segments: DataFrame) -> DataFrame:
    """One row per segment of a note: repeated deliveries collapse to the smallest segment_id."""
    flat = segments.filter("note_id is not null and segment_id is not null").select(
        "segment_id",
        "note_id",
        F.col("speaker.source").alias("source"),
        F.col("speaker.diarization_label").alias("label"),
        F.col("speaker.name").alias("name"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.col("start_time").cast("timestamp").alias("start_time"),
        F.col("end_time").cast("timestamp").alias("end_time"),
    )
    # the key is a digest: texts don't travel twice, and long texts don't become keys
    same = F.sha2(F.lower(F.regexp_replace("text", r"(?U)\s+", "")), 256)
    rows = flat.withColumn("same", same).groupBy("note_id", "start_time", "same").agg(F.min_by(F.struct("segment_id", "source", "label", "name", "text", "end_time"), "segment_id").alias("s"))
    return rows.select("s.segment_id", "note_id", "s.source", "s.label", "s.name", "s.text", "start_time", "s.end_time")


def in_buckets(rows: DataFrame) -> DataFrame:
    """`rows` with `at`, the start time that orders them (null last), and `bucket`, which ascends with (at, segment_id).

    A bucket is BUCKET_S seconds; rows without a time, which a note may have many of, are bucketed by their ids.
    """
    untimed = F.expr(f"{2**61} + shiftright(segment_id, {UNTIMED_BITS})")
    return rows.withColumn("bucket", F.coalesce(F.expr(f"unix_seconds(start_time) div {BUCKET_S}"), untimed)).withColumn("at", F.coalesce("start_time", F.lit("9999-12-31").cast("timestamp")))


def parsed_segments(segments: DataFrame) -> DataFrame:
    """Distinct segments with speech: speaker spellings and the text after label and decoration."""
    return distinct_segments(segments).mapInPandas(_parse, PARSED)


def same_person(spellings: Counter) -> dict[str, str]:
    """Spelling -> voice name, for the spellings of one note."""
    read = {s: parts(s) for s in spellings}
    full = Counter()
    for s, p in read.items():
        if len([w for w in p if len(w) > 1]) >= 2:
            full[p] += spellings[s]
    chosen: dict[tuple, tuple] = {}
    heads: list[tuple] = []
    for p, _ in sorted(full.items(), key=lambda x: (-x[1], x[0])):
        joined = " ".join(sorted(p))
        near = None
        for h in heads:
            if sorted(h) == sorted(p) or distance(joined, " ".join(sorted(h)), 2) <= 2 or distance(" ".join(p), " ".join(h), 2) <= 2 or set(h) >= set(p) or set(p) >= set(h):
                near = h
                break
        chosen[p] = near or p
        if not near:
            heads.append(p)
    weight = Counter()
    for p, n in full.items():
        weight[chosen[p]] += n

    def fits(p: tuple, h: tuple, slack: int) -> bool:
        if len(p) == 1:
            w = p[0]
            whole = [h[0], h[0][0] + h[-1], h[0] + h[-1], h[0] + h[-1][0], h[-1], h[-1] + h[0]]
            return any(w == x or (slack and len(w) > 3 and distance(w, x, slack) <= slack) for x in whole)
        long = [w for w in p if len(w) > 1]
        short = [w for w in p if len(w) == 1]
        rest = list(h)
        for w in long:
            hit = next((x for x in rest if x == w or (slack and len(w) > 3 and distance(w, x, slack) <= slack)), None)
            if hit is None:
                return False
            rest.remove(hit)
        for w in short:
            hit = next((x for x in rest if x[0] == w), None)
            if hit is None:
                return False
            rest.remove(hit)
        return True

    result, loose = {}, {}
    for s, p in read.items():
        if p in chosen:
            result[s] = " ".join(chosen[p])
            continue
        found = None
        for slack in (0, 1, 2):
            found = sorted((h for h in heads if p and fits(p, h, slack)), key=lambda h: (h[0] != p[0], -weight[h], h))
            if found:
                break
        if found:
            result[s] = " ".join(found[0])
        else:
            loose[s] = p
    # spellings of somebody whose full name the note never has: longer ones take in shorter ones
    anchors: list[tuple] = []
    for s, p in sorted(loose.items(), key=lambda x: (-len(" ".join(x[1])), x[1], x[0])):
        a = next((a for a in anchors if a == p or (p and a and (p[0] == a[0] or (len(p[0]) == 1 and a[0][0] == p[0]) or (len(a[0]) == 1 and p[0][0] == a[0]) or distance(p[0], a[0], 1) <= 1) and (len(p) == 1 or len(a) == 1 or p[-1][0] == a[-1][0]))), None)
        if a is None:
            anchors.append(p)
        result[s] = " ".join(a or p)
    return result


def voices_of(rows: list[dict]) -> list[str]:
    """The voice of each of one note's distinct (label, name, source) spellings with their counts n."""
    spellings = Counter()
    for r in rows:
        if r["name"] is not None:
            spellings[r["name"]] += r["n"]
    person = same_person(spellings)
    up: dict[str, str] = {}

    def find(x: str) -> str:
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    # a label stands for the person it is seen with most often
    seen: dict[str, Counter] = defaultdict(Counter)
    for r in rows:
        if r["label"] is not None and r["name"] is not None:
            seen["L" + r["label"]]["N" + person[r["name"]]] += r["n"]
    for label in sorted(seen):
        for name in sorted(seen[label]):
            a, b = find(label), find(name)
            if a != b:
                up[min(a, b)] = max(a, b)  # a name stands for a label
    return [find("L" + r["label"] if r["label"] is not None else "N" + person[r["name"]]) for r in rows]


def _voices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for note_id, rows in zip(pdf["note_id"], pdf["spellings"]):
            rows = list(rows)
            out += [(note_id, r["label"], r["name"], r["source"], r["n"], v) for r, v in zip(rows, voices_of(rows))]
        yield pd.DataFrame(out, columns=["note_id", "label", "name", "source", "n", "voice"])


def _evidence(counts: dict, usual, weight: float) -> float:
    """Log likelihood of outcomes whose probabilities are unknown but like `usual`, with the weight of that many observations."""
    if not counts:
        return 0.0
    return lgamma(weight) - lgamma(weight + sum(counts.values())) + sum(lgamma(weight * usual(k) + n) - lgamma(weight * usual(k)) for k, n in counts.items())


def links_of(forms: list, traits: list, moves: list) -> dict[str, str]:
    """Label never written with a name -> the person, never written with a label, whose voice it is by the note's speaker model.

    `forms` has of each voice the segments with `both`, with a label only (`labels`) and with a name only (`names`), and its sources.
    """
    labels = sorted((f for f in forms if not f["both"] and not f["names"]), key=lambda f: f["voice"])
    persons = sorted((f for f in forms if not f["both"] and not f["labels"]), key=lambda f: f["voice"])
    written = {k: 1.0 + sum(f[k] for f in forms if f["both"]) for k in ("both", "labels", "names")}
    rate = {k: log(n / sum(written.values())) for k, n in written.items()}
    rows: dict[str, Counter] = defaultdict(Counter)
    for m in moves:
        rows[m["a"]][m["b"]] += m["n"]
    into: dict[str, set] = defaultdict(set)
    for a, row in rows.items():
        for b in row:
            into[b].add(a)
    n_voices = len({f["voice"] for f in forms} | set(rows) | set(into))
    total = sum(row.total() for row in rows.values())
    stay = (sum(row[a] for a, row in rows.items()) + 1.0) / (total + 2.0)

    def leaving(a: str, row: dict, n: int) -> float:
        return _evidence(row, lambda b: stay if a == b else (1 - stay) / max(1, n - 1), SMOOTHING)

    apart = {a: leaving(a, row, n_voices) for a, row in rows.items()}
    fewer = {a: leaving(a, row, n_voices - 1) for a, row in rows.items()}
    base = sum(fewer.values()) - sum(apart.values())

    def merged(row: dict, label: str, person: str) -> Counter:
        out = Counter(row)
        out[person] += out.pop(label, 0)
        return +out

    everywhere: Counter = Counter()
    own: dict[str, dict[str, Counter]] = defaultdict(lambda: defaultdict(Counter))
    for t in traits:
        everywhere[t["trait"]] += t["n"]
        own[t["voice"]][t["trait"][0]][t["trait"]] += t["n"]
    of_kind = Counter()
    for trait, n in everywhere.items():
        of_kind[trait[0]] += n

    def spoken(counts: dict) -> float:
        return _evidence(counts, lambda t: everywhere[t] / of_kind[t[0]], SMOOTHING)

    def bare(f: dict, form: str) -> float:
        return log(BARE_VOICE + (1 - BARE_VOICE) * exp(f[form] * rate[form]))

    gains = []
    for f in labels:
        can_be = [g for g in persons if set(f["sources"]) & set(g["sources"])]
        for g in can_be:
            a, b = f["voice"], g["voice"]
            # each of them is as likely beforehand
            gain = base - log(len(can_be)) + f["labels"] * rate["labels"] + g["names"] * rate["names"] - bare(f, "labels") - bare(g, "names")
            for x in (into[a] & into[b]) - {a, b}:
                gain += leaving(x, merged(rows[x], a, b), n_voices - 1) - fewer[x]
            gain += leaving(b, merged(rows.get(a, Counter()) + rows.get(b, Counter()), a, b), n_voices - 1) - fewer.get(a, 0.0) - fewer.get(b, 0.0)
            for kind in own[a].keys() | own[b].keys():
                gain += spoken(own[a][kind] + own[b][kind]) - spoken(own[a][kind]) - spoken(own[b][kind])
            gains.append((-gain, a, b))
    links: dict[str, str] = {}
    for gain, a, b in sorted(gains):
        if -gain > log(LIKELIER) and a not in links and b not in links.values():
            links[a] = b
    return links


def _links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = [(r.note_id, a, b) for r in pdf.itertuples(index=False) for a, b in links_of(list(r.forms), list(r.traits), list(r.moves)).items()]
        yield pd.DataFrame(out, columns=["note_id", "voice", "person"])


class SpeakerModel:
    """The hidden Markov model of one note: voices that a segment without a label can be, their traits and transitions."""

    def __init__(self, states: list[str], traits: list, moves: list) -> None:
        self.states, self.place = states, {v: i for i, v in enumerate(states)}
        self.of_trait: dict[str, np.ndarray] = {}
        own, everywhere = defaultdict(Counter), Counter()
        self.on_mic = Counter()
        for t in traits:
            own[t["voice"]][t["trait"]] += t["n"]
            everywhere[t["trait"]] += t["n"]
        kinds = Counter(t[0] for t in everywhere)
        for trait in everywhere:
            # a voice that nothing is known of speaks like the whole note
            n = [(own[v] or everywhere)[trait] for v in states]
            of_kind = [sum(m for t, m in (own[v] or everywhere).items() if t[0] == trait[0]) for v in states]
            self.of_trait[trait] = np.log((np.array(n) + TRAIT_COUNT) / (np.array(of_kind) + TRAIT_COUNT * (kinds[trait[0]] + 1)))
        self.moves, self.leaving = Counter(), Counter()
        stays = 0
        for m in moves:
            self.moves[m["a"], m["b"]] += m["n"]
            self.leaving[m["a"]] += m["n"]
            stays += m["n"] if m["a"] == m["b"] else 0
        self.stay = (stays + 1.0) / (self.leaving.total() + 2.0)
        self.between = np.array([self.after(v) for v in states])

    def move(self, a: str, b: str) -> float:
        usual = self.stay if a == b else (1 - self.stay) / max(1, len(self.states) - 1)
        return np.log((self.moves[a, b] + SMOOTHING * usual) / (self.leaving[a] + SMOOTHING))

    def after(self, a: str | None) -> np.ndarray:
        """Scores of the states after voice `a`; nothing is known at the start of a note."""
        return np.zeros(len(self.states)) if a is None else np.array([self.move(a, b) for b in self.states])

    def before(self, b: str | None) -> np.ndarray:
        return np.zeros(len(self.states)) if b is None else np.array([self.move(a, b) for a in self.states])

    def emissions(self, sources: list[str | None], profiles: list[str]) -> np.ndarray:
        out = np.zeros((len(profiles), len(self.states)))
        for i, (source, profile) in enumerate(zip(sources, profiles)):
            for trait in profile.split("|"):
                if (known := self.of_trait.get(trait)) is not None:
                    out[i] += known
            # a further voice is on its own source only; whoever is named, or labelled, on the microphone is on the microphone only
            out[i] += [0.0 if (v == f"-{source or '?'}" if v.startswith("-") else source == "microphone") else NEVER for v in self.states]
        return out

    def path(self, emitted: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[int]:
        """Best states, given the scores before the first and after the last of them."""
        score, back = first + emitted[0], []
        for row in emitted[1:]:
            step = score[:, None] + self.between
            back.append(step.argmax(axis=0))
            score = step.max(axis=0) + row
        at = int((score + last).argmax())
        states = [at]
        for step in reversed(back):
            at = int(step[at])
            states.append(at)
        return states[::-1]

    def through(self, emitted: np.ndarray) -> np.ndarray:
        """Best score of a part from each first to each last state."""
        n = len(self.states)
        score = np.where(np.eye(n, dtype=bool), emitted[0][:, None], NEVER * 1e3)
        for row in emitted[1:]:
            score = (score[:, :, None] + self.between[None]).max(axis=1) + row
        return score

    def ends(self, parts_: list[np.ndarray], before: str | None, after: str | None) -> list[tuple[int, int]]:
        """(first, last) state of each part on the best path through all of them."""
        score = (self.after(before)[:, None] + parts_[0]).max(axis=0)
        trail = [(self.after(before)[:, None] + parts_[0]).argmax(axis=0)]
        links = []
        for part in parts_[1:]:
            reach = score[:, None] + self.between
            links.append(reach.argmax(axis=0))
            total = reach.max(axis=0)[:, None] + part
            trail.append(total.argmax(axis=0))
            score = total.max(axis=0)
        last = int((score + self.before(after)).argmax())
        out = []
        for k in range(len(parts_) - 1, -1, -1):
            first = int(trail[k][last])
            out.append((first, last))
            last = int(links[k - 1][first]) if k else last
        return out[::-1]


def _models():
    """Model of a row's note; the last ones are kept."""
    kept: dict[str, SpeakerModel] = {}

    def model(r) -> SpeakerModel:
        if r.note_id not in kept:
            if len(kept) > 200:
                kept.clear()
            kept[r.note_id] = SpeakerModel(sorted(r.states), list(r.traits), list(r.moves))
        return kept[r.note_id]

    return model


def _through(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    model = _models()
    for pdf in batches:
        out = []
        for r in pdf.itertuples(index=False):
            m, said = model(r), list(r.said)
            out.append((r.note_id, r.pin, r.part, m.through(m.emissions([s["source"] for s in said], [s["profile"] for s in said])).ravel().tolist()))
        yield pd.DataFrame(out, columns=["note_id", "pin", "part", "scores"])


def _ends(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("part")
    m = _models()(pdf.iloc[0])
    n = len(m.states)
    found = m.ends([np.array(s).reshape(n, n) for s in pdf["scores"]], pdf.iloc[0]["before"], pdf.iloc[0]["after"])
    return pd.DataFrame({"note_id": pdf["note_id"], "pin": pdf["pin"], "part": pdf["part"], "first_state": [a for a, _ in found], "last_state": [b for _, b in found]})


def _decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    model = _models()
    for pdf in batches:
        ids, voices = [], []
        for r in pdf.itertuples(index=False):
            m, said = model(r), list(r.said)
            fixed = lambda at, m=m: np.where(np.arange(len(m.states)) == at, 0.0, NEVER * 1e3)
            first = m.after(r.before) if pd.isna(r.first_state) else fixed(int(r.first_state))
            last = m.before(r.after) if pd.isna(r.last_state) else fixed(int(r.last_state))
            ids += [s["segment_id"] for s in said]
            voices += [m.states[i] for i in m.path(m.emissions([s["source"] for s in said], [s["profile"] for s in said]), first, last)]
        yield pd.DataFrame({"segment_id": pd.Series(ids, dtype="int64"), "voice": pd.Series(voices, dtype="object")})


def voiced_segments(segments: DataFrame, *, block: int = BLOCK, text: bool = True) -> DataFrame:
    """(note_id, segment_id, source, start_time, end_time, spoken, voice) of all segments with speech; without `text` there is no `spoken`."""
    parsed = parsed_segments(segments)
    # texts that nobody asks for are neither written nor joined
    parsed = cut(parsed if text else parsed.drop("spoken"))
    named = F.col("label").isNotNull() | F.col("name").isNotNull()
    spellings = parsed.filter(named).groupBy("note_id", "label", "name", "source").agg(F.count("*").alias("n"))
    per_note = spellings.groupBy("note_id").agg(F.collect_list(F.struct("label", "name", "source", "n")).alias("spellings"))
    voices = cut(per_note.mapInPandas(_voices, "note_id string, label string, name string, source string, n long, voice string"))
    known = parsed.filter(named).join(
        voices.select("note_id", F.col("label").alias("l"), F.col("name").alias("nm"), F.col("source").alias("s"), "voice"),
        (parsed["note_id"] == voices["note_id"]) & F.col("label").eqNullSafe(F.col("l")) & F.col("name").eqNullSafe(F.col("nm")) & F.col("source").eqNullSafe(F.col("s")),
    ).select(parsed["*"], "voice")
    # without a label: one further voice of another source, the only voice of the microphone, or open
    bare = parsed.filter(~named).join(on_microphone(voices), "note_id", "left")
    mic = F.col("source").eqNullSafe("microphone") & F.col("on_mic").isNotNull()
    only = F.when(~mic, F.concat(F.lit("-"), F.coalesce("source", F.lit("?")))).when(F.size("on_mic") == 1, F.col("on_mic")[0])
    rows, n_open = cut_counted(in_buckets(known.unionByName(bare.withColumn("voice", only).drop("on_mic"))), F.col("voice").isNull())
    rows, voices = linked(rows, voices)
    columns = ["note_id", "segment_id", "source", "start_time", "end_time", *(["spoken"] if text else []), "voice"]
    if not n_open:
        return rows.select(columns)
    rows = cut(rows)
    return rows.filter("voice is not null").select(columns).unionByName(inferred(rows, voices, block).select(columns))


def on_microphone(voices: DataFrame) -> DataFrame:
    """(note_id, on_mic) of notes whose microphone has voices: persons, or labels where nobody is named there."""
    mic = voices.filter("source = 'microphone'").groupBy("note_id").agg(F.collect_set(F.when(F.col("voice").startswith("N"), F.col("voice"))).alias("persons"), F.collect_set("voice").alias("all"))
    return mic.select("note_id", F.when(F.size("persons") > 0, F.col("persons")).otherwise(F.col("all")).alias("on_mic"))


def profiles_and_moves(pinned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per note the traits of its voices, and what voice follows what (`previous` is the voice of the row before, if known)."""
    counted = pinned.select("note_id", "voice", F.explode(F.split("profile", r"\|")).alias("trait")).groupBy("note_id", "voice", "trait").agg(F.count("*").alias("n"))
    moved = pinned.filter("previous is not null").groupBy("note_id", F.col("previous").alias("a"), F.col("voice").alias("b")).agg(F.count("*").alias("n"))
    return counted.groupBy("note_id").agg(F.collect_list(F.struct("voice", "trait", "n")).alias("traits")), moved.groupBy("note_id").agg(F.collect_list(F.struct("a", "b", "n")).alias("moves"))


def linked(rows: DataFrame, voices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`rows` and `voices`, with the person's voice for labels never written with a name that the speaker model takes for that person's."""
    label, name = F.col("label").isNotNull(), F.col("name").isNotNull()
    count = lambda where: F.coalesce(F.sum(F.when(where, F.col("n"))), F.lit(0))
    forms = voices.groupBy("note_id", "voice").agg(count(label & name).alias("both"), count(label & ~name).alias("labels"), count(~label & name).alias("names"), F.collect_set(F.coalesce("source", F.lit("?"))).alias("sources"))
    forms = forms.groupBy("note_id").agg(F.collect_list(F.struct("voice", "both", "labels", "names", "sources")).alias("forms"))
    # labels and names are spellings of the same voices where a note writes some of them together
    forms, n_notes = cut_counted(forms.filter("exists(forms, f -> f.both > 0) and exists(forms, f -> f.both = 0 and f.names = 0) and exists(forms, f -> f.both = 0 and f.labels = 0)"))
    if not n_notes:
        return rows, voices
    said = rows.join(forms.select("note_id"), "note_id", "left_semi").select("note_id", "segment_id", "profile", "voice", "at", "bucket")
    traits, moves = profiles_and_moves(cut(with_previous(said, "note_id", "bucket", ["at", "segment_id"], "voice", "previous")).filter("voice is not null"))
    links, n_links = cut_counted(with_model(forms, traits, moves).mapInPandas(_links, "note_id string, voice string, person string"))
    if not n_links:
        return rows, voices
    renamed = lambda df: df.join(links, ["note_id", "voice"], "left").withColumn("voice", F.coalesce("person", "voice")).drop("person")
    return renamed(rows), renamed(voices)


def with_model(notes: DataFrame, traits: DataFrame, moves: DataFrame) -> DataFrame:
    """`notes` with their traits and moves, empty where there are none."""
    none = {"traits": "array<struct<voice:string,trait:string,n:bigint>>", "moves": "array<struct<a:string,b:string,n:bigint>>"}
    return notes.join(traits, "note_id", "left").join(moves, "note_id", "left").withColumns({k: F.coalesce(k, F.array().cast(t)) for k, t in none.items()})


def inferred(rows: DataFrame, voices: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows without a voice, which have several to choose from, with the one the hidden Markov model gives them."""
    unknown = rows.filter("voice is null")
    states = on_microphone(voices).withColumnRenamed("on_mic", "states").join(unknown.select("note_id").distinct(), "note_id", "left_semi")
    rows = rows.join(states.select("note_id"), "note_id", "left_semi").select("note_id", "segment_id", "source", "profile", "voice", "at", "bucket")
    # place of every row among the pins and among the rows without a voice, and the voice before it: one sort inside buckets, one row a bucket
    inside = W.partitionBy("note_id", "bucket").orderBy("at", "segment_id")
    upto = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    pin, gap = F.when(F.col("voice").isNotNull(), 1).otherwise(0), F.when(F.col("voice").isNull(), 1).otherwise(0)
    placed = rows.withColumns({"pin": F.sum(pin).over(upto), "nth": F.sum(gap).over(upto), "own": F.lag(F.struct("voice")).over(inside)})
    ends = rows.groupBy("note_id", "bucket").agg(F.sum(pin).alias("pins"), F.sum(gap).alias("gaps"), F.max_by(F.struct("voice"), F.struct("at", "segment_id")).alias("end"))
    per_note = W.partitionBy("note_id").orderBy("bucket")
    earlier = per_note.rowsBetween(W.unboundedPreceding, -1)
    ends = ends.select("note_id", "bucket", F.coalesce(F.sum("pins").over(earlier), F.lit(0)).alias("pins"), F.coalesce(F.sum("gaps").over(earlier), F.lit(0)).alias("gaps"), F.lag("end").over(per_note).alias("end"))
    placed = placed.join(ends, ["note_id", "bucket"]).select("note_id", "segment_id", "source", "profile", "voice", "at", (F.col("pin") + F.col("pins")).alias("pin"), (F.col("nth") + F.col("gaps")).alias("nth"), F.coalesce("own", "end")["voice"].alias("previous"))
    placed = cut(placed)
    pinned = placed.filter("voice is not null")
    model = with_model(states, *profiles_and_moves(pinned))
    gaps = placed.filter("voice is null")
    starts = gaps.groupBy("note_id", "pin").agg(F.min("nth").alias("first_nth"))
    gaps = gaps.join(starts, ["note_id", "pin"]).withColumn("part", F.expr(f"(nth - first_nth) div {block}"))
    said = F.transform(F.array_sort(F.collect_list(F.struct("nth", "segment_id", "source", "profile"))), lambda s: F.struct(s["segment_id"].alias("segment_id"), s["source"].alias("source"), s["profile"].alias("profile")))
    stretches = gaps.groupBy("note_id", "pin", "part").agg(said.alias("said"))
    before = pinned.join(starts.select("note_id", "pin"), ["note_id", "pin"], "left_semi").select("note_id", "pin", F.col("voice").alias("before"))
    after = pinned.select("note_id", (F.col("pin") - 1).alias("pin"), F.col("voice").alias("after"))
    stretches = stretches.join(before, ["note_id", "pin"], "left").join(after, ["note_id", "pin"], "left").join(model, "note_id")
    long = gaps.filter("part > 0").select("note_id", "pin").distinct()
    fixed = None
    if not long.isEmpty():
        parts_ = stretches.join(long, ["note_id", "pin"], "left_semi")
        scores = parts_.mapInPandas(_through, "note_id string, pin long, part long, scores array<double>")
        scores = scores.join(parts_.drop("said"), ["note_id", "pin", "part"])
        fixed = cut(scores.groupBy("note_id", "pin").applyInPandas(_ends, "note_id string, pin long, part long, first_state int, last_state int"))
    if fixed is None:
        stretches = stretches.withColumns({"first_state": F.lit(None).cast("int"), "last_state": F.lit(None).cast("int")})
    else:
        stretches = stretches.join(fixed, ["note_id", "pin", "part"], "left")
    decoded = stretches.mapInPandas(_decode, "segment_id long, voice string")
    return unknown.drop("voice").join(decoded, "segment_id")


def speaker_turns(segments: DataFrame, *, text: bool = True) -> DataFrame:
    """(note_id, turn_no, voice, first_segment_id, last_segment_id, start_time, end_time, n_segments, text, speaker), a row per turn; `text` on demand."""
    rows = in_buckets(cut(voiced_segments(segments, text=text)))
    runs = numbered_runs(rows, "note_id", "bucket", ["at", "segment_id"], "voice")
    place = F.struct("at", "segment_id")
    said = []
    if text:
        runs = runs.withColumn("clean", _clean("spoken"))
        said = [F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "segment_id", "clean"))), lambda s: s["clean"]), " ").alias("text")]
    turns = runs.groupBy("note_id", "run").agg(
        F.first("voice").alias("voice"),
        F.min_by("segment_id", place).alias("first_segment_id"),
        F.max_by("segment_id", place).alias("last_segment_id"),
        F.min("start_time").alias("start_time"),
        F.max(F.greatest("start_time", "end_time")).alias("end_time"),
        F.count("*").alias("n_segments"),
        *said,
    )
    speaker = F.when(F.col("voice").startswith("L"), F.concat(F.lit("Speaker "), F.upper(F.substring("voice", 2, 40)))).when(F.col("voice").startswith("N"), F.initcap(F.substring("voice", 2, 200)))
    return turns.withColumn("speaker", speaker).withColumnRenamed("run", "turn_no")
