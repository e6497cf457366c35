"""Linking variant spellings of people and companies.

1. Every name, alias and identifier is read into parts: a given name and a surname, an initial and a surname, a surname alone, a user
   name; or the core of a company's name without legal forms and trade words.
2. Distinct parts (not rows) are hashed: MinHash over padded q-grams, banded. The number of bands follows from the collision curve
   1 - (1 - s^r)^b for the wanted recall at the lowest similarity that the accepted edits leave to parts of LONG letters or more. Edits
   leave shorter parts too little similarity for bands (down to none at two letters): these also meet by what is left of them after
   as many deletions as edits are accepted, which misses no pair.
3. Pairs that share a band or a remainder are verified by edits, and clustered by star clustering: the strongest undecided part of its neighbourhood
   becomes a centre and takes its neighbours, in parallel rounds; parts that identifiers vouch for are never taken by others.
4. Names become keys of centres; nicknames stand for the given names they belong to where that person is known. A short form is linked
   when exactly one known person fits. A record is checked against its key by Monge-Elkan similarity.
5. Former names among the aliases join the keys of companies (components of a small graph).

Defined results: null and blank names are ignored; null record ids are ignored; repeated rows of a record are one record; types other
than persons and companies take no part; a short form that fits several known people stays alone unless an identifier decides.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notewarp.llm.names import distance, folded, parts
from notewarp.session import cut, cut_counted

#: q of the q-grams, rows of a band, wanted recall at the lowest similarity that edits leave to parts of LONG letters or more.
Q, ROWS, RECALL, LONG = 3, 3, 0.95, 30
#: Monge-Elkan similarity that a name must have with its key.
MONGE_ELKAN = 0.72
#: Rounds of star clustering (as many as the longest chain of ever stronger neighbours) and of components; more are an error, never a partial result.
MAX_ROUNDS = 64
#: Records of one entity whose pairs one task makes.
PAIR_RECORDS = 1000

# Nicknames and the given names they stand for.
NICKNAMES = {
    "abby": "abigail", "gail": "abigail", "ola": "aleksandra olga", "alex": "alexander aleksandra", "sasha": "alexander aleksandra", "ben": "benjamin", "benny": "benjamin",
    "chuck": "charles", "charlie": "charles", "concha": "concepcion", "conchita": "concepcion", "deb": "deborah", "debbie": "deborah", "lola": "dolores", "dot": "dorothy",
    "dolly": "dorothy", "dottie": "dorothy", "nell": "eleanor", "ellie": "eleanor", "nora": "eleanor", "lizzie": "elizabeth", "liz": "elizabeth", "beth": "elizabeth", "betty": "elizabeth",
    "paco": "francisco", "pancho": "francisco", "fred": "frederick", "freddy": "frederick", "rike": "friederike", "greg": "gregory", "memo": "guillermo", "heinz": "heinrich",
    "hal": "henry", "harry": "henry", "hank": "henry", "nacho": "ignacio", "bella": "isabel", "izzy": "isabel", "jenny": "jennifer", "jen": "jennifer", "joe": "joseph", "joey": "joseph",
    "hans": "johannes", "pepe": "jose", "katie": "katherine", "kathy": "katherine", "kate": "katherine", "larry": "lawrence", "meg": "margaret", "maggie": "margaret", "peggy": "margaret",
    "mike": "michael", "mick": "michael", "nick": "nicholas", "ollie": "oliver", "pat": "patricia", "patty": "patricia", "tricia": "patricia", "quinn": "quentin", "becky": "rebecca", "becca": "rebecca",
    "bob": "robert", "bobby": "robert", "rob": "robert", "sam": "samuel", "basti": "sebastian", "sue": "susan", "susie": "susan", "theo": "theodore", "ted": "theodore", "tim": "timothy", "tom": "thomas",
    "uli": "ulrich", "uschi": "ursula", "val": "valerie", "tori": "victoria", "vicky": "victoria", "will": "william", "billy": "william", "bill": "william", "wolf": "wolfgang", "zach": "zachary", "zack": "zachary", "xavi": "xavier", "kev": "kevin", "marge": "margaret", "chris": "christopher christina", "tony": "anthony", "steve": "stephen", "dave": "david", "dan": "daniel", "jim": "james", "jack": "john", "kit": "katherine", "lena": "helena magdalena", "sepp": "josef", "toni": "anton",
}
# Legal forms, and trade words with their short forms, that don't tell one company from another.
LEGAL = "ag bv b.v. co corp corp. corporation gmbh inc inc. incorporated kg limited llc ltd ltd. nv plc pty s.a. s.l. sa sarl sas sl spa srl".split()
TRADE = (
    "analytics analytix analytic anl brothers bros brother consulting consultants consult cons engineering eng engr engineers foods food group holding holdings international intl int'l int laboratories "
    "laboratory labs lab logistics logistik log manufacturing mfg manuf partners ptnrs partner services svcs service serv sons son systems system sys technologies technology tech technologie hq headquarters and the"
).split()
COMPANY_TYPES = ("company", "organization", "organisation", "business")

PARSED = "record_id long, kind string, origin string, form string, given string, family string"


def bands_for(similarity: float, recall: float, rows: int) -> int:
    """Bands needed so that a pair of that similarity shares one with probability `recall`."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


def plain(word: str) -> str:
    """A part as compared: without hyphens and apostrophes; ae, oe and ue are read as umlauts."""
    return re.sub(r"([aou])e(?!$)", r"\1", re.sub(r"[^a-z0-9]", "", word)) if word.isascii() else re.sub(r"[\W_]", "", word)


_NICK = {plain(nick): tuple(plain(w) for w in full.split()) for nick, full in NICKNAMES.items()}


def read_person(name: str) -> tuple[str, str, str] | None:
    """(form, given, family): `full`, `initial` (given is a letter), `single` (one word: a surname or a user name)."""
    found = [plain(w) for w in parts(name)]
    found = [w for w in found if w and w != "mx"]
    long, short = [w for w in found if len(w) > 1], [w for w in found if len(w) == 1]
    if len(long) >= 2:
        return "full", "".join(long[:-1]) if len(long) > 2 else long[0], long[-1]
    if len(long) == 1:
        return ("initial", short[0], long[0]) if short else ("single", "", long[0])
    return None


def read_company(name: str) -> str | None:
    """The core of a company's name, in one word."""
    text = re.sub(r"(?<=[a-zà-ÿ]{3})(?=[A-ZÀ-Þ][a-zà-ÿ]{2})", " ", name.replace(" ", " ")) if not name.isupper() else name
    words = [w.strip(".,;:()'’\"") for w in re.split(r"[\s/&+\-]+", folded(text))]
    words = [w for w in words if w and w not in LEGAL and w.replace(".", "") not in LEGAL]
    # a short form is the beginning of a trade word
    trade = lambda w: w in TRADE or (len(w) >= 3 and any(t.startswith(w.rstrip(".")) for t in TRADE))
    core = [w for i, w in enumerate(words) if not (w in TRADE or (i and trade(w)))] or words
    joined = "".join(plain(w) for w in core)
    for word in sorted(TRADE, key=len, reverse=True):
        if len(word) > 3 and joined.endswith(word) and len(joined) - len(word) >= 5:
            joined = joined[: -len(word)]
            break
    return joined or None


def read_email(value: str) -> tuple[str, str, str] | None:
    """Like read_person; an address that isn't given.family is read as far as its letters go (form `mailbox`)."""
    local, _, host = folded(value.strip()).partition("@")
    if not host:
        return None
    local = local.partition("+")[0]
    m = re.fullmatch(r"([a-z\-]{2,})[._]([a-z\-]{2,})\d*", local)
    if m:
        return "full", plain(m.group(1)), plain(m.group(2))
    m = re.match(r"[a-z\-]{5,}", local)
    return ("mailbox", "", plain(m.group())) if m else None


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for r in pdf.itertuples(index=False):
            if r.kind == "person":
                got = read_email(r.value) if r.origin == "email" else read_person(r.value)
                if got:
                    out.append((r.record_id, r.kind, r.origin, *got))
            elif r.origin == "website":
                m = re.match(r"(?:https?://)?(?:www\.)?([\w\-]+)", folded(r.value.strip()))
                if m:
                    out.append((r.record_id, r.kind, r.origin, "core", "", plain(m.group(1))))
            elif core := read_company(r.value):
                out.append((r.record_id, r.kind, r.origin, "core", "", core))
        yield pd.DataFrame(out, columns=["record_id", "kind", "origin", "form", "given", "family"])


def spellings(entities: DataFrame, extracted: DataFrame) -> DataFrame:
    """(record_id, kind, origin, value) of every name, alias and identifier of persons and companies."""
    kind = F.when(F.lower("type_key") == "person", "person").when(F.lower("type_key").isin(*COMPANY_TYPES), "company")

    def ids(frame: DataFrame, value: str) -> DataFrame:
        each = frame.select("record_id", kind.alias("kind"), F.explode("identifiers").alias("i"))
        return each.select("record_id", "kind", F.lower("i.field_key").alias("origin"), F.col(f"i.{value}").alias("value")).filter("origin in ('email', 'website')")

    rows = entities.select("record_id", kind.alias("kind"), F.lit("name").alias("origin"), F.col("canonical_name").alias("value"))
    rows = rows.unionByName(entities.select("record_id", kind.alias("kind"), F.lit("alias").alias("origin"), F.explode("aliases").alias("value")))
    rows = rows.unionByName(extracted.select("record_id", kind.alias("kind"), F.lit("name").alias("origin"), F.col("name").alias("value")))
    rows = rows.unionByName(ids(entities, "raw_value")).unionByName(ids(extracted, "value"))
    return rows.filter("record_id is not null and kind is not null and trim(value) <> ''").distinct()


def signature(word: str, seeds: np.ndarray) -> np.ndarray:
    """MinHash values of a word's padded q-grams."""
    padded = "#" * (Q - 1) + word + "#" * (Q - 1)
    grams = {padded[i : i + Q] for i in range(len(padded) - Q + 1)}
    base = np.array([xxhash.xxh64_intdigest(g) for g in grams], dtype=np.uint64)
    mixed = (base[:, None] ^ seeds) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed ^ (mixed >> np.uint64(29))).min(axis=0)


def edits(length: int) -> int:
    """Edits that a spelling mistake explains in a part of so many letters (of two parts, the shorter one counts)."""
    return 1 if length < 8 else 2 if length < 14 else 3


def lowest_similarity(length: int) -> float:
    """The least similarity of padded q-grams that the accepted edits leave to parts of that length: a swap touches q + 1 of them."""
    grams, touched = length + Q - 1, edits(length) * (Q + 1)
    return max(0, grams - touched) / (grams + touched)


def remainders(word: str) -> set[str]:
    """What is left of a word after up to its accepted edits deletions: parts within so many edits have one of these in common."""
    found = last = {word}
    for _ in range(edits(len(word))):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        found = found | last
    return found


def _bander(bands: int):
    seeds = np.random.default_rng(7).integers(1, 2**63, bands * ROWS, dtype=np.uint64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for kind, word, strength in zip(pdf["kind"], pdf["word"], pdf["strength"]):
                # a part of LONG letters may be within its edits of one that is a little shorter
                if len(word) < LONG + edits(LONG):
                    out += [(kind, word, strength, xxhash.xxh64_intdigest(w, bands) >> 1) for w in remainders(word)]
                if len(word) >= LONG:
                    sig = signature(word, seeds)
                    for b in range(bands):
                        out.append((kind, word, strength, xxhash.xxh64_intdigest(sig[b * ROWS : (b + 1) * ROWS].tobytes(), b) >> 1))
                if len(out) > 100_000:
                    yield pd.DataFrame(out, columns=["kind", "word", "strength", "bucket"])
                    out = []
            yield pd.DataFrame(out, columns=["kind", "word", "strength", "bucket"])

    return run


def alike(a: str, b: str) -> float:
    """1 minus the share of edits, 0 where there are more than a spelling mistake explains."""
    most = edits(min(len(a), len(b)))
    d = distance(a, b, most)
    return 0.0 if d > most else 1 - d / max(len(a), len(b))


@F.pandas_udf(T.DoubleType())
def _alike(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([alike(x, y) for x, y in zip(a, b)], dtype="float64")


def similar_words(words: DataFrame) -> DataFrame:
    """(kind, word, near, similarity): verified pairs, `near` the stronger one. `words` is (kind, word, vouched, support)."""
    ranked = words.withColumn("strength", F.to_json(F.struct(F.col("vouched").cast("int").alias("v"), F.col("support").alias("s"))))
    banded = ranked.select("kind", "word", "strength").mapInPandas(_bander(bands_for(lowest_similarity(LONG), RECALL, ROWS)), "kind string, word string, strength string, bucket long")
    banded = cut(banded.select("kind", "word", "bucket", F.get_json_object("strength", "$.v").cast("int").alias("v"), F.get_json_object("strength", "$.s").cast("long").alias("s")))
    left, right = banded.alias("a"), banded.alias("b")
    weaker = (F.struct(F.col("a.v"), F.col("a.s"), F.col("a.word")) < F.struct(F.col("b.v"), F.col("b.s"), F.col("b.word"))) & (F.col("a.v") == 0)
    pairs = left.join(right, (F.col("a.kind") == F.col("b.kind")) & (F.col("a.bucket") == F.col("b.bucket")) & weaker & (F.abs(F.length("a.word") - F.length("b.word")) <= 3))
    pairs = pairs.select(F.col("a.kind").alias("kind"), F.col("a.word").alias("word"), F.col("b.word").alias("near"), F.col("a.s").alias("s"), F.col("b.s").alias("near_s"), F.col("b.v").alias("near_v")).distinct()
    scored = pairs.withColumn("similarity", _alike("word", "near")).filter("similarity > 0")
    # short words are told apart by a letter: only a much commoner one, or one that identifiers vouch for, takes them
    return scored.filter((F.length("word") >= 7) | (F.col("near_s") >= 3 * F.col("s")) | (F.col("near_v") == 1)).select("kind", "word", "near", "similarity", "near_v", "near_s")


def star_centres(words: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, word, centre) of every word: parallel star clustering, stronger neighbours first."""
    edges = cut(edges)
    weaker = edges.select("kind", "word").distinct().withColumn("open", F.lit(True))
    undecided = F.col("centre").isNull()
    state, left = cut_counted(words.select("kind", "word").join(weaker, ["kind", "word"], "left").select("kind", "word", F.when(F.col("open").isNull(), F.col("word")).alias("centre")), undecided)
    for _ in range(MAX_ROUNDS):
        if not left:
            return state
        # a word goes to the best of its neighbours that are centres; it is one itself once all stronger neighbours have gone elsewhere
        near = edges.join(state.filter(undecided).select("kind", "word"), ["kind", "word"], "left_semi").join(state.select("kind", F.col("word").alias("near"), F.col("centre").alias("near_centre")), ["kind", "near"])
        seen = near.groupBy("kind", "word").agg(
            F.max(F.when(F.col("near_centre") == F.col("near"), F.struct("similarity", "near_v", "near_s", "near"))).alias("best"), F.max(F.col("near_centre").isNull()).alias("waiting")
        )
        decided = seen.filter(~F.col("waiting")).select("kind", "word", F.coalesce("best.near", "word").alias("decided"))
        state, left = cut_counted(state.join(decided, ["kind", "word"], "left").select("kind", "word", F.coalesce("centre", "decided").alias("centre")), undecided)
    if left:
        raise RuntimeError(f"{left} parts aren't settled after {MAX_ROUNDS} rounds")
    return state


def monge_elkan(a: list[str], b: list[str]) -> float:
    """Mean over the parts of `a` of the best similarity with a part of `b`; an initial counts like the part it begins."""

    def best(x: str) -> float:
        top = 0.0
        for y in b:
            if x == y or (len(x) == 1 and y.startswith(x)) or y in _NICK.get(x, ()):
                return 1.0
            d = distance(x, y, 4)
            if d <= 4:
                top = max(top, 1 - d / max(len(x), len(y)))
        return top

    return sum(map(best, a)) / len(a) if a else 0.0


@F.pandas_udf(T.DoubleType())
def _monge_elkan(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([monge_elkan([w for w in x.split(" ") if w], y.split("|")) for x, y in zip(a, b)], dtype="float64")


def _nickname_map() -> F.Column:
    items = [x for nick, full in _NICK.items() for x in (F.lit(nick), F.array(*[F.lit(w) for w in full]))]
    return F.create_map(*items)


def _pair_key(a: F.Column, b: F.Column) -> F.Column:
    return F.concat_ws("|", F.array_sort(F.array(a, b)))


def person_keys(read: DataFrame) -> DataFrame:
    """(record_id, key): the person of every record whose name or identifier tells. `read` has centres for given and family."""
    full = read.filter("form = 'full'")
    nick = _nickname_map()
    # a nickname stands for each of its given names, and for itself; the order of the parts is free
    sides = full.withColumn("a", F.explode(F.concat(F.array("given"), F.coalesce(nick[F.col("given")], F.array().cast("array<string>"))))).withColumn(
        "b", F.explode(F.concat(F.array("family"), F.coalesce(nick[F.col("family")], F.array().cast("array<string>"))))
    )
    keyed = sides.select("record_id", "origin", "spelled", _pair_key(F.col("a"), F.col("b")).alias("key"), ((F.col("a") != F.col("given")) | (F.col("b") != F.col("family"))).alias("by_nickname"), F.array("a", "b").alias("words"))
    keyed = cut(keyed)
    known = keyed.groupBy("key").agg(F.max(~F.col("by_nickname")).alias("named"), F.max(F.col("origin") == "email").alias("vouched"), F.count(F.when(~F.col("by_nickname"), 1)).alias("support"), F.first("words").alias("words"))
    known = cut(known.filter("named"))
    # of the readings of one spelling: the record's own choice, vouched ones, given names before nicknames, the commonest
    readings = keyed.join(known.select("key", "vouched", "support"), "key")
    is_nick = F.exists("words", lambda w: F.coalesce(nick[w].isNotNull(), F.lit(False)))
    # what most of a record's own spellings can be read as goes before what is common elsewhere
    own_votes = readings.groupBy("record_id", "key").agg(F.count_distinct("origin", "spelled").alias("own"))
    readings = readings.join(own_votes, ["record_id", "key"])
    readings = readings.withColumn("rank", F.struct("own", F.col("vouched").cast("int").alias("v"), (~is_nick).cast("int").alias("g"), F.col("support").alias("s"), F.col("key").alias("k")))
    chosen = readings.groupBy("record_id", "origin", "spelled").agg(F.max_by("key", "rank").alias("key"))
    # a key that is only somebody's nickname stands aside for the person it was read as
    people = cut(chosen.select("key").distinct().join(known.select("key", "words"), "key"))
    by_family = people.select("key", F.posexplode("words").alias("at", "family"), "words").withColumn("other", F.element_at("words", F.when(F.col("at") == 0, 2).otherwise(1)))
    by_initial = by_family.groupBy("family", F.substring("other", 1, 1).alias("given")).agg(F.count_distinct("key").alias("n"), F.min("key").alias("key"))
    by_name = by_family.groupBy("family").agg(F.count_distinct("key").alias("n"), F.min("key").alias("key"))
    initial = read.filter("form = 'initial'").select("record_id", "origin", "spelled", "given", "family").join(by_initial, ["given", "family"], "left")
    initial = initial.withColumn("key", F.when(F.col("n").isNull(), F.concat_ws("|", F.lit("?"), "family", "given")).when(F.col("n") == 1, F.col("key")))
    single = read.filter("form = 'single'").select("record_id", "origin", "spelled", "given", "family")
    # a user name is an initial before a surname
    user = single.withColumn("given", F.substring("spelled", 1, 1)).withColumn("tail", F.expr("substring(spelled, 2)"))
    as_user = user.join(by_initial.select("given", F.col("family").alias("tail"), "n", "key"), ["given", "tail"])
    near_user = user.join(by_initial, ["given", "family"]).filter(~F.col("spelled").startswith(F.col("family")))
    as_user = as_user.select("record_id", "origin", "spelled", "n", "key").unionByName(near_user.select("record_id", "origin", "spelled", "n", "key"))
    as_user = as_user.groupBy("record_id", "origin", "spelled").agg(F.when(F.count_distinct("key") == 1, F.max("n")).otherwise(2).alias("n"), F.min("key").alias("key"))
    plain_name = single.join(as_user.select("record_id", "origin", "spelled"), ["record_id", "origin", "spelled"], "left_anti").join(by_name, "family", "left")
    plain_name = plain_name.withColumn("key", F.when(F.col("n").isNull(), F.concat_ws("|", F.lit("?"), "family", F.lit(""))).when(F.col("n") == 1, F.col("key")))
    # a mailbox begins with the given name and the first letters of the surname
    stem = by_family.select("key", F.concat("other", F.substring("family", 1, 5)).alias("stem")).distinct()
    box = read.filter("form = 'mailbox'").select("record_id", "origin", "spelled").join(stem, F.col("spelled") == F.col("stem"))
    box = box.groupBy("record_id", "origin", "spelled").agg(F.count_distinct("key").alias("n"), F.min("key").alias("key"))
    columns = ["record_id", "origin", "spelled", "key"]
    votes = chosen.select(columns).unionByName(initial.select(columns)).unionByName(as_user.filter("n = 1").select(columns)).unionByName(plain_name.select(columns)).unionByName(box.filter("n = 1").select(columns))
    return votes.filter("key is not null")


def linked_records(entities: DataFrame, extracted: DataFrame) -> DataFrame:
    """(record_id, kind, entity): the person or company of every record of those kinds that names one."""
    read, _ = cut_counted(spellings(entities, extracted).mapInPandas(_parse, PARSED))
    family = read.filter("form <> 'mailbox'").select("kind", F.col("family").alias("word"), "record_id", F.col("origin").isin("email", "website").alias("vouched"))
    given = read.filter("form = 'full'").select("kind", F.col("given").alias("word"), "record_id", (F.col("origin") == "email").alias("vouched"))
    # nicknames and given names of the table are words in their own right
    fixed = sorted({w for n, full in _NICK.items() for w in (n, *full)})
    vouched = F.col("vouched") | ((F.col("kind") == "person") & F.col("word").isin(*fixed))
    words = cut(family.unionByName(given).filter("length(word) >= 2").groupBy("kind", "word").agg(F.max(vouched).alias("vouched"), F.count_distinct("record_id").alias("support")))
    centres = star_centres(words, similar_words(words))
    as_centre = centres.select("kind", F.col("word").alias("of"), "centre")
    read = read.withColumn("spelled", F.col("family")).join(as_centre.withColumnRenamed("of", "family"), ["kind", "family"], "left").withColumn("family", F.coalesce("centre", "family")).drop("centre")
    read = read.withColumn("first", F.col("given")).join(as_centre.withColumnRenamed("of", "given"), ["kind", "given"], "left").withColumn("given", F.coalesce("centre", "given")).drop("centre")
    read = cut(read.withColumn("spelled", F.when(F.col("form") == "full", F.concat_ws(" ", "first", "spelled")).otherwise(F.col("spelled"))).drop("first"))
    votes = person_keys(read.filter("kind = 'person'"))
    checked = cut(votes.withColumn("sure", (F.col("origin") == "email") | F.col("key").startswith("?") | (_monge_elkan("spelled", "key") >= MONGE_ELKAN)))
    # an address decides, then the name itself, then aliases; a known person before an unknown one
    weight = F.when(F.col("origin") == "email", 4).when(F.col("origin") == "name", 2).otherwise(1) - F.when(F.col("key").startswith("?"), 2).otherwise(0)
    people = checked.filter("sure").groupBy("record_id", "key").agg(F.max(weight).alias("w"), F.count("*").alias("n"))
    people = people.groupBy("record_id").agg(F.max_by("key", F.struct("w", "n", "key")).alias("core"))
    # a former surname among the aliases: a full name with one part in common
    former = checked.filter("sure and not startswith(key, '?')").join(read.filter("form = 'full'").select("record_id", "origin", "spelled").distinct(), ["record_id", "origin", "spelled"], "left_semi")
    former = former.select("record_id", F.col("key").alias("other")).join(people, "record_id").filter("core <> other").filter(F.size(F.array_intersect(F.split("core", r"\|"), F.split("other", r"\|"))) > 0)
    cores = read.filter("kind = 'company'").select("record_id", "origin", F.col("family").alias("core")).distinct()
    own = cores.groupBy("record_id").agg(F.max_by("core", F.struct(F.when(F.col("origin") == "website", 3).when(F.col("origin") == "name", 2).otherwise(1), "core")).alias("core"))
    edges = cores.select("record_id", F.col("core").alias("other")).join(own, "record_id").filter("core <> other").select("core", "other")
    of = lambda frame, kind: frame.select(F.concat(F.lit(f"{kind}:"), "core").alias("core"), F.concat(F.lit(f"{kind}:"), "other").alias("other"))
    joined = components(of(former.select("core", "other"), "person").unionByName(of(edges, "company")).distinct())
    records = people.select("record_id", F.lit("person").alias("kind"), "core").unionByName(own.select("record_id", F.lit("company").alias("kind"), "core"))
    records = records.withColumn("core", F.concat_ws(":", "kind", "core")).join(joined, "core", "left")
    return records.select("record_id", "kind", F.expr("substring(coalesce(component, core), length(kind) + 2)").alias("entity"))


def components(edges: DataFrame) -> DataFrame:
    """(core, component) of every end of the edges (core, other): least label of its component, by hooking and jumping."""
    both = cut(edges.unionByName(edges.select(F.col("other").alias("core"), F.col("core").alias("other"))).distinct())
    labels = cut(both.groupBy("core").agg(F.least(F.col("core"), F.min("other")).alias("component")))
    for _ in range(MAX_ROUNDS):
        offered = both.join(labels.select(F.col("core").alias("other"), F.col("component").alias("theirs")), "other").groupBy("core").agg(F.min("theirs").alias("theirs"))
        hooked = labels.join(offered, "core").select("core", F.least("component", "theirs").alias("component"), F.col("component").alias("before"))
        jumped = hooked.join(hooked.select(F.col("core").alias("component"), F.col("component").alias("beyond")), "component", "left").select("core", F.coalesce("beyond", "component").alias("component"), "before")
        jumped, changed = cut_counted(jumped, F.col("component") != F.col("before"))
        labels = jumped.select("core", "component")
        if not changed:
            return labels
    raise RuntimeError(f"components aren't settled after {MAX_ROUNDS} rounds")


def with_links(linked: DataFrame) -> DataFrame:
    """`linked` with n_links: how many other records mean the same."""
    sizes = linked.groupBy("kind", "entity").agg((F.count("*") - 1).alias("n_links"))
    return linked.join(sizes, ["kind", "entity"]).select("record_id", "kind", "entity", "n_links")


def record_pairs(linked: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: the records of one entity. The result is all pairs by its definition; a large entity's are made in parts."""
    parts_ = linked.groupBy("kind", "entity").agg(F.expr(f"cast((count(*) - 1) div {PAIR_RECORDS} as int)").alias("last_part"), F.count("*").alias("n")).filter("n > 1").drop("n")
    rows = linked.join(parts_, ["kind", "entity"])
    a = rows.select("kind", "entity", F.col("record_id").alias("id_a"), F.explode(F.sequence(F.lit(0), F.col("last_part"))).alias("part"))
    b = rows.select("kind", "entity", F.col("record_id").alias("id_b"), F.pmod(F.xxhash64("record_id"), F.col("last_part") + 1).cast("int").alias("part"))
    return a.join(b, ["kind", "entity", "part"]).filter("id_a < id_b").select("id_a", "id_b")
