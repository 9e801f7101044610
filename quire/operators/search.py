"""Trigram BM25 search, vector search, rank fusion and snippets over a page corpus."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions.text import char_ngrams, fold_search, let

K1, B, FEWEST_IDF = 1.2, 0.75, 1e-6
MOST_TERMS = 40
RRF = 60


def index_pages(pages: DataFrame, lower: bool = True, compose: bool = False) -> DataFrame:
    """pages with txt, the folded text that the index and the queries share."""
    # A generator of one row: Catalyst would otherwise put the fold in each place that names txt.
    return spread(pages).select("*", F.explode(F.array(fold_search(F.col("raw"), compose, lower))).alias("txt"))


def spread(df: DataFrame) -> DataFrame:
    """Deal a table of fewer partitions than cores over all of them; larger tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def postings(indexed: DataFrame, only: Sequence[str] | None = None) -> DataFrame:
    """(term, id, tf, dl), dl the page's number of terms. Terms are counted within each page before any shuffle; with ``only``, others never become rows."""
    grams = char_ngrams(F.col("txt"))
    if only is not None:
        grams = F.filter(grams, lambda x: x.isin(list(only)))  # a hash set's lookup
    n = F.length(F.col("txt"))
    return indexed.select("id", F.when(n >= 3, n - 2).otherwise(1).alias("dl"), F.explode(grams).alias("term")).groupBy("term", "id").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))


def counted(indexed: DataFrame) -> DataFrame:
    """postings() of all terms without a shuffle: a page's terms are numbers of 63 bits, three code points each, sorted and counted by page over an Arrow batch."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, of, ids, tf, dl in _counts(batches):
            yield pa.RecordBatch.from_arrays([names.take(pa.array(of)), ids, pa.array(tf), pa.array(dl)], ["term", "id", "tf", "dl"])

    kind = indexed.schema["id"].dataType.simpleString()
    return indexed.select("id", "txt").mapInArrow(count, f"term string, id {kind}, tf long, dl int")


def blocked(indexed: DataFrame) -> DataFrame:
    """counted() with a term's postings of a run of pages as one row of lists, (term, id, tf, dl): what is shuffled and sorted is a term of a run, not a posting."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, of, ids, tf, dl in _counts(batches):
            order = np.argsort(of, kind="stable")
            ends = pa.array(np.r_[0, np.cumsum(np.bincount(of, minlength=len(names)))].astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, x) for x in (ids.take(pa.array(order)), pa.array(tf[order]), pa.array(dl[order]))]
            yield pa.RecordBatch.from_arrays([names, *lists], ["term", "id", "tf", "dl"])

    kind = indexed.schema["id"].dataType.simpleString()
    return indexed.select("id", "txt").mapInArrow(count, f"term string, id array<{kind}>, tf array<bigint>, dl array<int>")


def unblocked(blocks: DataFrame) -> DataFrame:
    """The postings of blocked(), or postings as they are. A filter by term reaches the blocks."""
    return blocks.select("term", F.inline(F.arrays_zip("id", "tf", "dl"))) if blocks.schema["id"].dataType.typeName() == "array" else blocks


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(terms, and of each posting its term's number, id, tf, dl) for runs of pages (id, txt)."""
    for batch in batches:
        ids, texts = batch.column(0), [(t or "").replace(" ", "_") for t in batch.column(1).to_pylist()]
        size = np.array([len(t) for t in texts], np.int64)
        for first, last in _runs(size):
            some, own = texts[first:last], size[first:last]
            points = np.frombuffer("".join(some).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
            ends = np.cumsum(own)
            page = np.repeat(np.arange(len(some)), own)
            whole = np.flatnonzero(np.arange(len(points)) + 2 < ends[page])  # where a run of three begins
            code = points[whole] << 42 | points[whole + 1] << 21 | points[whole + 2]
            order = np.lexsort((code, page[whole]))
            code, at = code[order], page[whole][order]
            edges = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (at[1:] != at[:-1])]) if len(code) else np.empty(0, np.int64)
            tf = np.diff(np.r_[edges, len(code)])
            names, of = np.unique(code[edges], return_inverse=True)
            terms = pa.array([chr(c >> 42) + chr(c >> 21 & 0x1FFFFF) + chr(c & 0x1FFFFF) for c in names.tolist()], pa.string())
            yield terms, of, ids.take(pa.array(at[edges] + first)), tf, (own[at[edges]] - 2).astype(np.int32)
            short = np.flatnonzero(own < 3)
            yield pa.array([some[i] for i in short.tolist()], pa.string()), np.arange(len(short)), ids.take(pa.array(short + first)), np.ones(len(short), np.int64), np.ones(len(short), np.int32)


def _runs(size: np.ndarray, most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Pages of a batch in runs of few characters, so that memory stays flat; a longer page is a run of its own."""
    start = held = 0
    for i, n in enumerate(size.tolist()):
        if held and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if len(size):
        yield start, len(size)


def lengths(indexed: DataFrame) -> DataFrame:
    """(id, dl): each page's number of terms, without making them."""
    n = F.length(F.col("txt"))
    return indexed.select("id", F.when(n >= 3, n - 2).otherwise(1).alias("dl"))


def vocabulary(posted: DataFrame) -> DataFrame:
    return posted.groupBy("term").agg(F.count(F.lit(1)).alias("doc"))


def folded_query(spark: SparkSession, text: str, lower: bool = True) -> str:
    return spark.sql("SELECT 1").select(fold_search(F.lit(text), False, lower).alias("t")).first()["t"]  # folded while it is planned: no job


def query_terms(spark: SparkSession, text: str) -> list[str]:
    """A query's terms in order, repeated ones included: a handful on the driver, as the query itself."""
    u = folded_query(spark, text).replace(" ", "_")
    return [] if not u else [u] if len(u) < 3 else [u[i : i + 3] for i in range(len(u) - 2)]


def page_counts(terms: Sequence[str], vocabulary: DataFrame) -> dict[str, int]:
    """How many pages hold each of a query's terms; terms of none are left out."""
    return {r["term"]: r["doc"] for r in vocabulary.where(F.col("term").isin(list(dict.fromkeys(terms)))).collect()} if terms else {}


def rarest(terms: Sequence[str], doc: DataFrame | dict[str, int], most: int = MOST_TERMS) -> list[str]:
    """Over ``most`` terms, the distinct ones with the fewest pages (none counts as 0), earlier first; else all as they are. doc: page_counts() or a vocabulary."""
    if len(terms) <= most:
        return list(terms)
    doc = doc if isinstance(doc, dict) else page_counts(terms, doc)
    return sorted(dict.fromkeys(terms), key=lambda t: doc.get(t, 0))[:most]


def bm25(postings: DataFrame, terms: Sequence[str], n: int, avgdl: float, doc: dict[str, int] | None = None) -> DataFrame:
    """(id, score) for pages that hold a term; the lower the better, as in SQLite's bm25(). A repeated query term counts each time.

    The terms are literals, so stored postings are pruned where they are scanned. A page's parts, one for each distinct term, are summed by size, so equal pages have
    equal scores to the last bit, however their rows arrive, and go by id. doc: page_counts(), else counted among the same rows.
    """
    spark = postings.sparkSession
    times = {t: terms.count(t) for t in terms}
    hits = postings.where(F.col("term").isin(list(times)))
    if doc is None:
        doc = {r["term"]: r["doc"] for r in vocabulary(hits).collect()}
    df = {t: doc[t] for t in times if t in doc}
    if not df:
        return spark.createDataFrame([], "id long, score double")
    weight = F.create_map(*[F.lit(x) for t, d in df.items() for x in (t, times[t] * max(math.log((n - d + 0.5) / (d + 0.5)), FEWEST_IDF))])
    part = weight[F.col("term")] * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(avgdl)))
    return hits.groupBy("id").agg((-F.aggregate(F.array_sort(F.collect_list(part)), F.lit(0.0), lambda s, x: s + x)).alias("score"))


def covered(txt: Column, terms: Sequence[str], aware: bool = False) -> Column:
    """Part of the query's terms that a page's text holds; aware compares with blanks as underscores."""
    t = F.translate(txt, " ", "_") if aware else txt
    return let(t, lambda u: sum((u.contains(x).cast("int") for x in terms), F.lit(0))) / F.lit(float(len(terms)))


def search_trigram(index, text: str, k: int, book: str | None = None, aware: bool = False) -> DataFrame:
    """(id, book, page, score, coverage), best k: BM25's first 3 k, then those that hold enough of the query's terms.

    index: a SearchIndex. Only 3 k ids and a query's terms reach the driver.
    """
    spark = index.pages.sparkSession
    asked = query_terms(spark, text)
    doc = page_counts(asked, index.vocabulary)
    listed = rarest(asked, doc)
    scored = bm25(index.postings, listed, index.n, index.avgdl, doc) if listed else spark.createDataFrame([], "id long, score double")
    if book is not None:
        scored = scored.join(index.pages.where(F.col("book") == book).select("id"), "id", "left_semi")
    top = {r["id"]: r["score"] for r in scored.orderBy("score", "id").limit(3 * k).collect()}
    if not top:
        return index.pages.limit(0).select("id", "book", "page", F.lit(0.0).alias("score"), F.lit(0.0).alias("coverage"))
    score = F.create_map(*[F.lit(x) for i, s in top.items() for x in (i, s)])
    met = index.pages.where(F.col("id").isin(list(top))).select("id", "book", "page", score[F.col("id")].alias("score"), covered(F.col("txt"), listed, aware).alias("coverage"))
    need = 0.34 if len(listed) >= 12 else 0.55
    return met.where(F.col("coverage") >= need).orderBy("score", "id").limit(k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def search_vectors(store: DataFrame, key: str, query: Sequence[float], k: int, keep: Column | None = None) -> DataFrame:
    """(key, score) of the best k by dot product. The filter comes after the first max(5 k, 200), so fewer than k may be left."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = store.withColumn("score", dot(F.col("embedding"), q)).orderBy(F.desc("score"), key).limit(max(5 * k, 200))
    scored = scored.where(keep) if keep is not None else scored
    return scored.orderBy(F.desc("score"), key).limit(k).select(key, "score")


def fuse(lists: Sequence[DataFrame], key: str, order: Sequence[Column], k: int) -> DataFrame:
    """Reciprocal rank fusion of ranked lists, each of a query's top results: (key, score); ties keep the earlier list's order."""
    ranked = None
    for i, (df, by) in enumerate(zip(lists, order, strict=True)):
        one = df.select(key, F.row_number().over(Window.orderBy(by, key)).alias("rank"), F.lit(i).alias("list"))
        ranked = one if ranked is None else ranked.unionByName(one)
    return ranked.groupBy(key).agg(F.sum(1 / (RRF + F.col("rank"))).alias("score"), F.min(F.struct("list", "rank")).alias("first")).orderBy(F.desc("score"), "first").limit(k).select(key, "score")


def snippet(raw: Column, wanted: Sequence[str], window: int = 30, shown: int = 40, width: int = 260) -> Column:
    """The words from the best window on: the first run of ``window`` words with most query words.

    Without query words, and for texts of white space alone, the text's start. One count rolls along the words.
    """
    if not wanted:
        return F.left(F.coalesce(raw, F.lit("")), F.lit(width))

    def best(words: Column, hit: Column) -> Column:
        first = F.aggregate(F.slice(hit, 1, window), F.lit(0), lambda a, x: a + x)
        start = F.struct(first.alias("now"), first.alias("most"), F.lit(0).alias("at"))

        def step(s: Column, i: Column) -> Column:
            now = s["now"] - F.get(hit, i - 1) + F.get(hit, i + window - 1)
            return F.struct(now.alias("now"), F.greatest(now, s["most"]).alias("most"), F.when(now > s["most"], i).otherwise(s["at"]).alias("at"))

        later = F.filter(F.sequence(F.lit(0), F.greatest(F.size(words) - window, F.lit(0))), lambda i: i > 0)
        return F.left(F.array_join(F.slice(words, F.aggregate(later, start, step)["at"] + 1, F.lit(shown)), " "), F.lit(2 * width))

    words = F.filter(F.split(raw, r"\s+"), lambda w: F.length(w) > 0)
    hits = lambda ws: F.transform(ws, lambda w: fold_search(w, False, True).isin(*wanted).cast("int"))
    return let(words, lambda ws: F.when(F.size(ws) > 0, let(hits(ws), lambda h: best(ws, h))).otherwise(F.left(F.coalesce(raw, F.lit("")), F.lit(width))))


UNAVAILABLE = "trigram (subject search unavailable)"


def search(index, text: str, limit: int, mode: str = "trigram", vectors: DataFrame | None = None, query_vector: Sequence[float] | None = None, book: str | None = None) -> DataFrame:
    """(rank, id, mode, snippet): trigram, semantic or hybrid search over a SearchIndex, each list twice as long as the result.

    vectors: (id, book, embedding). Without vector results semantic search is trigram search under a mode that says so, and
    hybrid search is trigram search. An unknown mode is searched as hybrid without a list.
    """
    spark = index.pages.sparkSession
    inner, vector_hits = 2 * limit, None
    if mode in ("hybrid", "semantic") and vectors is not None and query_vector is not None:
        near = search_vectors(vectors, "id", query_vector, inner, None if book is None else F.col("book") == book)
        vector_hits = near if near.head(1) else None
    if mode == "semantic" and vector_hits is None:
        mode = UNAVAILABLE
    if mode == "semantic":
        order = vector_hits.orderBy(F.desc("score"), "id").limit(limit)
    else:
        order = search_trigram(index, text, inner, book).select("id", "score")
        order = order.orderBy("score", "id").limit(limit) if vector_hits is None else fuse([order, vector_hits], "id", [F.col("score"), F.desc("score")], limit)
    ids = [r["id"] for r in order.collect()]
    if not ids:
        return spark.createDataFrame([], "rank int, id long, mode string, snippet string")
    wanted = sorted(set(folded_query(spark, text).split()))
    rank = F.create_map(*[F.lit(x) for i, v in enumerate(ids, 1) for x in (v, i)])
    found = index.pages.where(F.col("id").isin(ids)).select(rank[F.col("id")].alias("rank"), "id", F.lit(mode).alias("mode"), snippet(F.col("raw"), wanted).alias("snippet"))
    return found.orderBy("rank")
