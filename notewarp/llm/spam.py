"""Keyword-stuffed pages, link lists and tag dumps.

1. Word rates per language are counted over all pages; what is kept is the words above a minimum rate, so the table has at most
   1 / COMMON_RATE words a language and can be sent to every task.
2. A page's words give its rank-frequency curve. Words of one frequency share a stretch of ranks, so a page is sent on as its few
   distinct frequencies; SQL windows turn them into ranks and aggregates fit log frequency against log rank: slope and residual.
   A page's divergence is the mean surprise of its words under the rates of its language's prose. A page without any function word has
   the language under whose rates its words surprise least.
3. Slope, residual and divergence are compared with the median and spread of the pages of the same language and comparable length that
   count as prose; a length with few of them is pooled with its neighbours. Extremes, and nothing else, are suspects (and all pages of a
   language that has no prose to be compared with).
4. Exact check of the suspects alone: the characters in links, and in stretches without the words that sentences are made of (common
   words of the language that aren't this page's own overused keywords), must be more than half of the page. In a page of fewer than
   CURVE_WORDS words, which has no curve to speak of, a stretch must show a link, a tag or a repeated word to count.

Defined results: null and empty texts are not reported; null ids are ignored; an id with several rows is reported once if any of its
texts is; null, wrong or odd `lang` values don't matter, the language is read from the words; very long texts are read whole; empty tables
give empty results.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from notewarp.llm.turns import LANGUAGE_WORDS
from notewarp.session import cut, cut_counted

#: Words kept as the language's own: at least this share of all its words.
COMMON_RATE = 1e-4
#: A page's word is its keyword if it makes up this share of the page, so many times the language's rate, at least so often.
KEYWORD_SHARE, KEYWORD_TIMES, KEYWORD_LEAST = 0.012, 4.0, 3
#: Spreads from the median at which a feature is extreme.
EXTREME = 2.0
#: Prose pages that medians and spreads are taken from, if the language has so many: a thinner length is pooled with its neighbours.
POOLED = 30
#: Suspects whose ids (some 30 bytes each) are sent to every task; more are joined by a shuffle, with the same result.
SENT_SUSPECTS = 500_000
#: Words from which a page has a curve.
CURVE_WORDS = 8

# Words that also stand inside noun phrases and so don't prove a sentence.
NOUN_WORDS = frozenset("the a an of and & le la les l un une de des du d et der die das den dem ein eine und el los las una del y e o u".split())
# Words that hold sentences together; those inside noun phrases ("la liste de") are left out.
SENTENCE_WORDS = {
    "en": "to is that for it we was not with you i in on are have be if when as at by this can will so but before after because although since who what until while despite given were did does would could let us them then still".split(),
    "de": "ist nicht wir ich zu für mit auf war es wer im in am wird hat wurde weil was bis als noch sich nach haben obwohl dann trotz wegen solange damit bevor mehr niemand kannst können".split(),
    "fr": "est pas nous je pour avec que sur qui on a il ne dans ce au aux par plus car si sont comme rien faute après avant malgré tant parce afin bien peux".split(),
    "es": "es no por para con que en se lo al ya más qué hasta son como sin porque hay ello quien después aunque mientras pesar antes cuando falta puedes".split(),
}
# Of those, words that also stand in the names of products and offers.
OFFER_WORDS = frozenset("to in on con en pas par sin no a al so plus".split())
_LINK = re.compile(r"<a\s[^>]*>|</a>|\]\([^)\s]*\)|(?:https?://|www\.)\S+", re.I)
_TAG = re.compile(r"(?<!\w)#\w+")
_TOKEN = re.compile(r"[^\W_]+")
_STRETCH = re.compile(r"\n+|[.!?…]+\s+|\s[»·|/•;>]\s")
_LANGUAGES = {lang: tuple({*LANGUAGE_WORDS[lang], *words}) for lang, words in SENTENCE_WORDS.items()}
_SPOKEN_IN = {w: tuple(lang for lang, words in _LANGUAGES.items() if w in words) for w in {w for words in _LANGUAGES.values() for w in words}}
_BONDS = frozenset(w for words in SENTENCE_WORDS.values() for w in words)
_SURE = _BONDS - OFFER_WORDS - NOUN_WORDS
#: A page counts as prose for the rates with this share, and so many different, of the words that hold sentences together.
PROSE_SHARE, PROSE_DIFFERENT = 0.08, 5
#: A word proves a sentence if its rate in prose is so many times its rate on other pages, of all languages and of its own.
PROOF_TIMES, OWN_PROOF_TIMES = 8.0, 2.0


def language(counts: Counter, logs: dict[str, dict[str, float]] | None = None) -> str:
    """Language whose function words make up most of the page; without any, the one whose log rates fit best, `?` where there are none."""
    hits = dict.fromkeys(_LANGUAGES, 0)
    for w in counts.keys() & _SPOKEN_IN.keys():
        for lang in _SPOKEN_IN[w]:
            hits[lang] += counts[w]
    best = max(hits, key=hits.get)
    if hits[best]:
        return best
    return min(sorted(logs), key=lambda lang: surprise(counts, logs[lang])) if logs else "?"


def log_rates(rates: dict[str, dict[str, float]]) -> dict[str, dict[str, float]]:
    return {lang: {w: math.log(p) for w, p in own.items()} for lang, own in rates.items()}


def surprise(counts: Counter, logs: dict[str, float]) -> float:
    """Mean of -log rate over a page's words; unknown words have a tenth of the least rate."""
    floor, get = math.log(COMMON_RATE / 10), logs.get
    return -sum([n * get(w, floor) for w, n in counts.items()]) / max(1, counts.total())


def page_words(text: str) -> Counter:
    return Counter(_TOKEN.findall(text.lower()))


def bonds(counts: Counter) -> tuple[int, int]:
    """How many words of a page hold sentences together, and how many different ones."""
    hits = counts.keys() & _BONDS
    return sum([counts[w] for w in hits]), len(hits)


def is_prose(counts: Counter) -> bool:
    held, different = bonds(counts)
    return different >= PROSE_DIFFERENT and held >= PROSE_SHARE * counts.total()


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total: dict[tuple[str, bool], Counter] = {}
    for pdf in batches:
        for text in pdf["text"]:
            words = _TOKEN.findall(text.lower())
            counts = Counter(words)
            total.setdefault((language(counts), is_prose(counts)), Counter()).update(words)
        # a task holds a bounded number of words
        if sum(map(len, total.values())) > 500_000:
            yield _flush(total)
            total = {}
    yield _flush(total)


def _flush(total: dict[tuple[str, bool], Counter]) -> pd.DataFrame:
    return pd.DataFrame([(lang, prose, w, n) for (lang, prose), counts in total.items() for w, n in counts.items()], columns=["lang", "prose", "word", "n"])


def language_rates(pages: DataFrame) -> tuple[dict[str, dict[str, float]], set[str]]:
    """Language -> word -> rate in prose, and the words that prove a sentence, from all pages.

    Only words above COMMON_RATE come to the driver: at most 1 / COMMON_RATE a language.
    """
    counted = pages.select("text").mapInPandas(_count, "lang string, prose boolean, word string, n long")
    in_prose = F.when(F.col("prose"), F.col("n")).otherwise(0)
    counts = cut(counted.groupBy("lang", "word").agg(F.sum(in_prose).alias("n"), F.sum(F.col("n") - in_prose).alias("other")))
    totals = {r.lang: (r.n, r.other) for r in counts.groupBy("lang").agg(F.sum("n").alias("n"), F.sum("other").alias("other")).collect()}
    rates: dict[str, dict[str, float]] = {}
    others = counts.groupBy("word").agg(F.sum("other").alias("elsewhere"))
    all_other = max(1, sum(o for _, o in totals.values()))
    known = [lang for lang, (n, _) in totals.items() if n]
    if not known:
        return {}, set()
    least = F.create_map(*[x for lang in known for x in (F.lit(lang), F.lit(totals[lang][0] * COMMON_RATE))])
    common = counts.filter(F.col("lang").isin(known)).filter(F.col("n") >= least[F.col("lang")]).join(others, "word")
    proof: set[str] = set()
    for r in common.toLocalIterator():
        rates.setdefault(r.lang, {})[r.word] = r.n / totals[r.lang][0]
        if rates[r.lang][r.word] >= max(PROOF_TIMES * r.elsewhere / all_other, OWN_PROOF_TIMES * r.other / max(1, totals[r.lang][1])):
            proof.add(r.word)
    return rates, proof - NOUN_WORDS


def unlike_prose(text: str, keywords: set[str], proof_words: set[str], *, short: bool = False) -> int:
    """Characters in links and in stretches that have none of the words sentences are made of; 0 once half of the page is sentences."""
    amiss, sound = 0, 0
    for stretch in _STRETCH.split(text):
        if not stretch:
            continue
        bare = _LINK.sub(" ", stretch) if "/" in stretch or "www." in stretch or "WWW." in stretch else stretch
        words = _TOKEN.findall((_TAG.sub(" ", bare) if "#" in bare else bare).lower())
        proof = sum(1 for w in words if w in _SURE or (w in proof_words and w not in keywords))
        fine = proof and proof >= 0.12 * len(words)
        if short and not fine:
            fine = bare is stretch and "#" not in bare and len(set(words)) == len(words)
        if fine:
            amiss += len(stretch) - len(bare)
            sound += len(bare)
            # what is left, separators included, can't be more than half
            if 2 * sound >= len(text):
                return 0
        else:
            amiss += len(stretch)
    return amiss


def overused(counts: Counter, rates: dict[str, float]) -> set[str]:
    """A page's keywords: words far above their language's rate."""
    total, floor = counts.total(), COMMON_RATE / 10
    least = max(KEYWORD_LEAST, KEYWORD_SHARE * total)
    return {w for w, n in counts.items() if n >= least and n >= KEYWORD_TIMES * total * rates.get(w, floor)}


def page_features(text: str, logs: dict[str, dict[str, float]]) -> tuple[int, str, bool, float, list[int], list[int]]:
    """(words, language, whether prose, divergence, distinct frequencies, words of each) of one page."""
    counts = page_words(text)
    lang = language(counts, logs)
    by = sorted(Counter(counts.values()).items(), reverse=True)
    return counts.total(), lang, is_prose(counts), surprise(counts, logs.get(lang, {})), [f for f, _ in by], [n for _, n in by]


def _features(rates: dict[str, dict[str, float]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        logs = log_rates(rates)
        for pdf in batches:
            rows = [(d, h, *page_features(t, logs)) for d, h, t in zip(pdf["doc_id"], pdf["text_hash"], pdf["text"])]
            yield pd.DataFrame(rows, columns=["doc_id", "text_hash", "n_words", "lang", "prose", "divergence", "freqs", "sizes"])

    return run


def with_texts(documents: DataFrame) -> DataFrame:
    """(doc_id, text_hash, text) of every row with an id and a text."""
    return documents.filter("doc_id is not null and text is not null and length(text) > 0").select("doc_id", F.xxhash64("text").alias("text_hash"), "text")


def page_curves(pages: DataFrame, rates: dict[str, dict[str, float]]) -> DataFrame:
    """(doc_id, text_hash, n_words, lang, prose, divergence, slope, residual) of every page."""
    page = ["doc_id", "text_hash"]
    about = ["n_words", "lang", "prose", "divergence"]
    made = cut(pages.mapInPandas(_features(rates), "doc_id long, text_hash long, n_words int, lang string, prose boolean, divergence double, freqs array<int>, sizes array<int>"))
    points = made.dropDuplicates(page).select(*page, *about, F.explode_outer(F.arrays_zip("freqs", "sizes")).alias("p")).select(*page, *about, F.col("p.freqs").alias("f"), F.col("p.sizes").alias("n"))
    through = W.partitionBy(*page).orderBy(F.desc("f")).rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = points.withColumn("last_rank", F.sum("n").over(through)).select(
        "*", F.log(F.sqrt((F.col("last_rank") - F.col("n") + 1) * F.col("last_rank").cast("double"))).alias("x"), F.log(F.col("f").cast("double")).alias("y")
    )
    fits = ranked.groupBy(*page).agg(
        *[F.max(c).alias(c) for c in about], F.count("*").alias("points"), F.regr_sxx("y", "x").alias("sxx"), F.regr_sxy("y", "x").alias("sxy"), F.regr_syy("y", "x").alias("syy")
    )
    slope = F.when(F.col("sxx") > 0, F.col("sxy") / F.col("sxx")).otherwise(0.0)
    left = F.greatest(F.lit(0.0), F.coalesce("syy", F.lit(0.0)) - F.when(F.col("sxx") > 0, F.col("sxy") * F.col("sxy") / F.col("sxx")).otherwise(0.0))
    return fits.select(*page, *about, slope.alias("slope"), F.sqrt(left / F.col("points")).alias("residual"))


def pools(cells: dict[tuple[str, int], int]) -> list[tuple[str, int, int]]:
    """(lang, band, of): the bands that each cell (lang, band) is compared with, from the prose pages of every cell.

    The bands next to a cell are added on both sides until there are POOLED prose pages or no more bands of the language.
    """
    bands: dict[str, dict[int, int]] = {}
    for (lang, band), n in cells.items():
        bands.setdefault(lang, {})[band] = n
    result = []
    for lang, counts in bands.items():
        for band in counts:
            for width in range(1 + max(abs(b - band) for b in counts)):
                near = [b for b in counts if abs(b - band) <= width]
                if sum(counts[b] for b in near) >= POOLED:
                    break
            result += [(lang, band, b) for b in near if counts[b]]
    return result


def suspects(curves: DataFrame) -> DataFrame:
    """`curves` with `extreme`: whether slope, residual or divergence is far from same-language prose of comparable length."""
    curves = curves.withColumn("band", F.floor(F.log2(F.col("n_words") + 1)).cast("int"))
    names = ["slope", "residual", "divergence"]
    # languages and bands are few: 5 x 40 rows at most
    cells = {(r.lang, r.band): r.n for r in curves.groupBy("lang", "band").agg(F.count(F.when(F.col("prose"), 1)).alias("n")).collect()}
    pool = curves.sparkSession.createDataFrame(pools(cells), "lang string, band int, of int")
    prose = curves.filter("prose").select("lang", F.col("band").alias("of"), *names).join(F.broadcast(pool), ["lang", "of"])
    middle = prose.groupBy("lang", "band").agg(*[F.percentile_approx(c, 0.5, 200).alias(f"{c}_mid") for c in names])
    offset = prose.join(F.broadcast(middle), ["lang", "band"])
    spread = offset.groupBy("lang", "band").agg(*[F.first(f"{c}_mid").alias(f"{c}_mid") for c in names], *[F.percentile_approx(F.abs(F.col(c) - F.col(f"{c}_mid")), 0.5, 200).alias(f"{c}_spread") for c in names])
    placed = curves.join(F.broadcast(spread), ["lang", "band"], "left")
    far = [F.abs(F.col(c) - F.col(f"{c}_mid")) > EXTREME * 1.4826 * (F.col(f"{c}_spread") + 1e-9) for c in names]
    # without prose of its language a page has nothing to be compared with
    return placed.withColumn("extreme", F.coalesce(far[0] | far[1] | far[2], F.lit(True)))


def _check(rates: dict[str, dict[str, float]], proof_words: set[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for doc, lang, text in zip(pdf["doc_id"], pdf["lang"], pdf["text"]):
                counts = page_words(text)
                amiss = unlike_prose(text, overused(counts, rates.get(lang, {})), proof_words, short=counts.total() < CURVE_WORDS)
                if 2 * amiss > len(text):
                    found.append(doc)
            yield pd.DataFrame({"doc_id": pd.Series(found, dtype="int64")})

    return run


def spam_pages(documents: DataFrame) -> DataFrame:
    """doc_id of pages of which more than half is keywords, links, tags or labels."""
    pages = with_texts(documents)
    rates, proof_words = language_rates(pages)
    suspected, n = cut_counted(suspects(cut(page_curves(pages, rates))).filter("extreme").select("doc_id", "text_hash", "lang"))
    # only the suspects' texts are read again; while they are few, their ids go to the texts, and not the texts to them
    suspected = F.broadcast(suspected) if n <= SENT_SUSPECTS else suspected
    return pages.join(suspected, ["doc_id", "text_hash"]).mapInPandas(_check(rates, proof_words), "doc_id long").distinct()
