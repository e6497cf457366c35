"""Full-text search: phrase matching, BM25, rank fusion; over a scan, or over a stored inverted index.

The scan needs no shuffle and reads texts once: a document's tokens stay in its row, phrase frequencies are counted there and written
with its length, and the corpus statistics (documents, tokens, documents per phrase) come back as one aggregated row. The stored index
is a list of segments, each partitioned by a hash of the term: a query reads the partitions of its terms only, and an update writes a
segment of the changed documents only. What a later segment has changed counts no more in earlier ones.

Defined results: an empty query, or one with a word without letters and digits, finds nothing; null texts are empty; documents
without an id are ignored; ties in score go by id; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from notewarp.functions.scalar import clamp
from notewarp.functions.text import normalize_query, query_phrases, tokens
from notewarp.operators.snapshot import Manifests
from notewarp.session import cut

# Parameters of the ranking, the least inverse document frequency, rank fusion, and the bounds of a limit.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
FUSION = 60
DEFAULT_LIMIT, MAX_LIMIT = 20, 100
#: Partitions of a stored index.
TERM_BUCKETS = 256

RESULT = "kind string, object_id string, title string, snippet string, score double, group_key string, type_key string, note_id string"


def phrase_frequency(words: Column, phrase: list[str]) -> Column:
    """Occurrences of adjacent tokens in an array of tokens, overlapping ones too."""
    if len(phrase) == 1:
        return F.size(F.filter(words, lambda t: t == phrase[0]))

    def begins(t: Column, i: Column) -> Column:
        here = t == phrase[0]
        for k, later in enumerate(phrase[1:], 1):
            here = here & (F.get(words, i + k) == later)
        return here

    return F.size(F.filter(words, begins))


def inverse_frequency(documents: int, having: int) -> float:
    import math

    return max(math.log((documents - having + 0.5) / (having + 0.5)), LEAST_IDF)


def bm25(docs: DataFrame, id_col: str, columns: list[str], phrases: list[list[str]], *, only: list[str] | None = None) -> DataFrame:
    """(id, bm25) of the documents that have every phrase in the columns `only` (default all); lower is better.

    A document's length counts all columns.
    """
    words = docs.filter(F.col(id_col).isNotNull()).select(id_col, *[tokens(F.col(c)).alias(c) for c in columns])
    length = sum((F.size(c) for c in columns), F.lit(0))
    counts = [sum((phrase_frequency(F.col(c), p) for c in (only or columns)), F.lit(0)).alias(f"f{i}") for i, p in enumerate(phrases)]
    # written, since a filter on the counts would be moved below the tokens, where a phrase makes them again at each place it is looked for
    rows = cut(words.select(id_col, length.alias("length"), *counts))
    names = [f"f{i}" for i in range(len(phrases))]
    stats = rows.agg(F.count("*").alias("n"), F.sum("length").alias("tokens"), *[F.count(F.when(F.col(f) > 0, 1)).alias(f) for f in names]).first()
    n = stats["n"] or 0
    average = (stats["tokens"] or 0) / n if n else 1.0
    found = rows
    for f in names:
        found = found.filter(F.col(f) > 0)
    norm = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("length") / F.lit(average or 1.0))
    score = sum((F.lit(inverse_frequency(n, stats[f])) * F.col(f) * F.lit(K1 + 1) / (F.col(f) + norm) for f in names), F.lit(0.0))
    return found.select(id_col, (-score).alias("bm25"))


def top(ranked: DataFrame, id_col: str, limit: int) -> DataFrame:
    """The best `limit` rows, ties by id."""
    return ranked.orderBy("bm25", id_col).limit(clamp(limit, 1, MAX_LIMIT))


def empty_results(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], RESULT)


def fuse(streams: list[DataFrame], query: str, *, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Ranked streams (kind, object_id, title, bm25, ...) as one: 1 / (60 + rank), plus 1 where the title is the query.

    Streams hold at most MAX_LIMIT rows each, so the windows and the order are over a bounded number of rows.
    """
    rows = streams[0]
    for s in streams[1:]:
        rows = rows.unionByName(s, allowMissingColumns=True)
    rank = F.row_number().over(W.partitionBy("kind").orderBy("bm25", "object_id"))
    same = normalize_query(F.col("title")) == F.lit(" ".join(query.casefold().split()))
    scored = rows.withColumn("rank", rank).withColumn("score", F.when(same, 1.0).otherwise(0.0) + F.lit(1.0) / (F.lit(FUSION) + F.col("rank")))
    return scored.orderBy(F.desc("score"), "kind", "object_id").limit(clamp(limit, 1, MAX_LIMIT))


#: Segments from which an update merges all of them into one.
MOST_SEGMENTS = 16


class TextIndex:
    """A stored inverted index below `path`: segments of postings, and the changed documents of each; statistics in the manifest."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._manifests = Manifests(spark, self.path)

    def exists(self) -> bool:
        return self._manifests.newest() > 0

    def build(self, docs: DataFrame, id_col: str, columns: list[str], *, buckets: int = TERM_BUCKETS) -> None:
        """Index `docs` anew."""
        self._publish([self._segment(docs, id_col, columns, None, buckets)], columns, buckets)

    def update(self, docs: DataFrame, id_col: str, *, gone: DataFrame | None = None) -> None:
        """Index `docs` in place of their former rows; `gone` (id) are documents that are no more. Nothing else is read but lengths."""
        m = self._manifests.read()
        made = self._segment(docs, id_col, m["columns"], gone, m["buckets"])
        segments = [*m["segments"], made]
        if len(segments) > MOST_SEGMENTS:
            segments = [self._merged(segments)]
        self._publish(segments, m["columns"], m["buckets"])

    def _publish(self, segments: list[str], columns: list[str], buckets: int) -> None:
        live = self._lengths(segments).filter("length is not null").agg(F.count("*").alias("n"), F.sum("length").alias("tokens")).first()
        self._manifests.publish(self._manifests.newest() + 1, {"segments": segments, "columns": columns, "buckets": buckets, "n": live["n"], "tokens": live["tokens"] or 0})

    def _changed(self, segments: list[str]) -> DataFrame:
        """(doc, length, segment) of every change, length null where the document has gone."""
        schema, each = "doc string, length int", None
        for i, name in enumerate(segments):
            rows = self.spark.read.schema(schema).parquet(f"{self.path}/{name}/changed").withColumn("segment", F.lit(i))
            each = rows if each is None else each.unionByName(rows)
        return each

    def _lengths(self, segments: list[str]) -> DataFrame:
        """(doc, segment, length): the last change of each document."""
        rows = self._changed(segments)
        return rows if len(segments) == 1 else rows.groupBy("doc").agg(F.max("segment").alias("segment"), F.max_by("length", "segment").alias("length"))

    def _segment(self, docs: DataFrame, id_col: str, columns: list[str], gone: DataFrame | None, buckets: int) -> str:
        import uuid

        name = f"segment-{uuid.uuid4().hex}"
        once = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("doc"), *[tokens(F.col(c)).alias(c) for c in columns])
        length = sum((F.size(c) for c in columns), F.lit(0)).cast("int")
        words = cut(once.groupBy("doc").agg(F.min(F.struct(*columns)).alias("w")).select("doc", "w.*").withColumn("length", length))
        changed = words.select("doc", "length")
        if gone is not None:
            left = gone.select(F.col(gone.columns[0]).cast("string").alias("doc")).distinct().join(words.select("doc"), "doc", "left_anti")
            changed = changed.unionByName(left.select("doc", F.lit(None).cast("int").alias("length")))
        changed.write.parquet(f"{self.path}/{name}/changed")
        each = None
        for i, c in enumerate(columns):
            rows = words.select("doc", "length", F.lit(i).alias("col"), F.posexplode(c).alias("pos", "term"))
            each = rows if each is None else each.unionByName(rows)
        postings = each.groupBy("term", "doc", "col", "length").agg(F.array_sort(F.collect_list("pos")).alias("positions"))
        self._write(postings.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")), name)
        return name

    def _write(self, postings: DataFrame, name: str) -> None:
        # a common term is spread over several files by its documents
        postings.repartition("bucket", F.pmod(F.xxhash64("doc"), F.lit(8))).write.partitionBy("bucket").parquet(f"{self.path}/{name}/postings")

    def _postings(self, segments: list[str]) -> DataFrame:
        schema, each = "term string, doc string, col int, length int, positions array<int>, bucket int", None
        for i, name in enumerate(segments):
            rows = self.spark.read.schema(schema).parquet(f"{self.path}/{name}/postings").withColumn("segment", F.lit(i))
            each = rows if each is None else each.unionByName(rows)
        return each

    def _merged(self, segments: list[str]) -> str:
        import uuid

        name = f"segment-{uuid.uuid4().hex}"
        live = cut(self._lengths(segments).filter("length is not null"))
        live.select("doc", "length").write.parquet(f"{self.path}/{name}/changed")
        self._write(self._postings(segments).join(live.select("doc", "segment"), ["doc", "segment"], "left_semi").drop("segment"), name)
        return name

    def search(self, query: str, *, only: list[str] | None = None, limit: int | None = DEFAULT_LIMIT) -> DataFrame:
        """(doc, bm25) of the best documents; of all that match where `limit` is None."""
        none = self.spark.createDataFrame([], "doc string, bm25 double")
        phrases, m = query_phrases(query), self._manifests.read()
        if phrases is None or not m or not m["n"]:
            return none
        terms = sorted({t for p in phrases for t in p})
        wanted = [r[0] for r in self.spark.range(1).select(F.explode(F.array(*[F.pmod(F.xxhash64(F.lit(t)), F.lit(m["buckets"])).cast("int") for t in terms]))).collect()]
        postings = self._postings(m["segments"]).filter(F.col("bucket").isin(*wanted) & F.col("term").isin(*terms))
        if len(m["segments"]) > 1:
            later = self._changed(m["segments"][1:]).select("doc", (F.col("segment") + 1).alias("since")).groupBy("doc").agg(F.max("since").alias("since"))
            postings = postings.join(later, "doc", "left").filter("since is null or segment >= since")
        if only:
            postings = postings.filter(F.col("col").isin(*[m["columns"].index(c) for c in only]))
        postings = postings.select("term", "doc", "col", "length", "positions")
        per_phrase = None
        for i, phrase in enumerate(phrases):
            hits = postings.filter(F.col("term") == phrase[0]).select("doc", "col", "length", F.col("positions").alias("at"))
            for k, t in enumerate(phrase[1:], 1):
                nxt = postings.filter(F.col("term") == t).select("doc", "col", F.expr(f"transform(positions, p -> p - {k})").alias("shifted"))
                hits = hits.join(nxt, ["doc", "col"]).select("doc", "col", "length", F.array_intersect("at", "shifted").alias("at"))
            freq = hits.groupBy("doc", "length").agg(F.sum(F.size("at")).alias("f")).filter("f > 0").select("doc", "length", F.lit(i).alias("phrase"), "f")
            per_phrase = freq if per_phrase is None else per_phrase.unionByName(freq)
        per_phrase = cut(per_phrase)
        having = {r["phrase"]: r["n"] for r in per_phrase.groupBy("phrase").agg(F.count("*").alias("n")).collect()}
        if len(having) < len(phrases):
            return none
        average = m["tokens"] / m["n"] or 1.0
        weights = F.element_at(F.array(*[F.lit(inverse_frequency(m["n"], having[i])) for i in range(len(phrases))]), F.col("phrase") + 1)
        norm = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("length") / F.lit(average))
        scored = per_phrase.withColumn("s", weights * F.col("f") * F.lit(K1 + 1) / (F.col("f") + norm))
        ranked = scored.groupBy("doc").agg(F.count("*").alias("n"), (-F.sum("s")).alias("bm25")).filter(F.col("n") == len(phrases)).drop("n")
        return ranked if limit is None else top(ranked, "doc", limit)
