"""The stored search index: postings, vocabulary, pages with their folded text and page lengths, written once and opened many times.

Postings, in lists of a term's over a run of pages, are sorted by term and pages by id, in small row groups, so a search's few terms and results prune nearly all of a
scan. An index is named after its pages' files and their times: other files give another index.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import search as S

_SMALL_GROUPS = {"parquet.block.size": str(1 << 20), "parquet.page.size": str(1 << 16)}
#: Postings of a partition, about.
PARTITION = 4_000_000


@dataclass(frozen=True)
class SearchIndex:
    """pages: (id, book, page, raw, txt); postings: (term, id, tf, dl); vocabulary: (term, doc); n and avgdl of all pages."""

    pages: DataFrame
    postings: DataFrame
    vocabulary: DataFrame
    n: int
    avgdl: float


def _files(spark: SparkSession, pages: DataFrame) -> str:
    """A digest of the names, sizes and times of the files that pages are read from."""
    conf, out = spark._jsc.hadoopConfiguration(), []
    for name in sorted(pages.inputFiles()):
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(conf).getFileStatus(path)
        out.append(f"{name} {status.getLen()} {status.getModificationTime()}")
    return hashlib.sha256("\n".join(out).encode()).hexdigest()[:24]


def shared_root(spark: SparkSession) -> str:
    """The folder of indexes and streams: shared by driver and executors."""
    named = spark.conf.get("spark.quire.index.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.quire.index.dir or spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{(named or 'file:///tmp/quire-index').rstrip('/')}/quire"


def sorted_files(table: DataFrame, key: str, path: str, parts: int | None = None) -> None:
    """A table dealt by key and sorted, in small row groups, so that a look for some keys reads little of it."""
    dealt = table.repartition(parts, key) if parts else table.repartition(key)
    dealt.sortWithinPartitions(key).write.mode("overwrite").options(**_SMALL_GROUPS).parquet(path)


def build(pages: DataFrame, path: str) -> None:
    """Write the index of pages(id, book, page, raw) under path. Texts are folded once; a page's equal terms are one row before the shuffle."""
    spark = pages.sparkSession

    def write(table: DataFrame, key: str, name: str, parts: int) -> DataFrame:
        # by hash, for ranges would need a sample and so a second run of what makes the rows
        sorted_files(table, key, f"{path}/{name}", parts)
        return spark.read.parquet(f"{path}/{name}")

    cores = spark.sparkContext.defaultParallelism
    stored = write(S.index_pages(pages).select("id", "book", "page", "raw", "txt"), "id", "pages", max(cores, pages.rdd.getNumPartitions()))
    terms = stored.select(F.sum(F.least(F.length("txt"), F.lit(2000)))).first()[0] or 0  # a page's distinct terms, at most about
    parts = max(1, terms // PARTITION)
    blocks = write(S.blocked(S.spread(stored)), "term", "postings", parts)
    write(blocks.groupBy("term").agg(F.sum(F.size("id")).alias("doc")), "term", "vocabulary", max(1, parts // 8))
    S.lengths(stored).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")).coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")  # written last: it marks the index as whole


def open_index(pages: DataFrame, path: str | None = None) -> SearchIndex:
    """The stored index of pages, built first where there is none. pages must come from files."""
    spark = pages.sparkSession
    path = path or f"{shared_root(spark)}/search/{_files(spark, pages)}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/stats/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        build(pages, path)
    stats = spark.read.parquet(f"{path}/stats").first()
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    return SearchIndex(read("pages"), S.unblocked(read("postings")), read("vocabulary"), stats["n"], stats["avgdl"] or 0.0)
