"""The harvest protocol's lists: pages by resumption tokens, sets and errors."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHUNK = 100
PARTS = 64
#: Keys that ranges' edges are chosen from, about; edges only share out the work.
DRAWN = 100 * PARTS


def numbered(books: DataFrame, key: str) -> DataFrame:
    """books with ``nth`` from 0 in order of key: places within key ranges, and ranges' bases by prefix sums, so no task holds all.

    The ranges' edges are found once and are values of the plan: where each run of an exchange by ranges draws its own edges, places and bases are of different ranges.
    """
    keys = books.select(key).where(F.col(key).isNotNull())
    drawn = sorted(r[0] for r in keys.sample(min(1.0, DRAWN / max(keys.count(), 1)), seed=7).collect())
    edges = sorted({drawn[len(drawn) * i // PARTS] for i in range(1, PARTS)}) if drawn else []
    part = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e < F.col(key))) if edges else F.lit(0)
    return _ranked(books.withColumn("part", F.coalesce(part, F.lit(0))), key)


def _ranked(parted: DataFrame, key: str, *group: str) -> DataFrame:
    """parted with ``nth`` from 0 in order of key, in each group; part: of a row's key, no less for a larger key."""
    own = parted.withColumn("i", F.row_number().over(Window.partitionBy(*group, "part").orderBy(key)) - 1)
    before = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = parted.groupBy(*group, "part").agg(F.count(F.lit(1)).alias("n")).select(*group, "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return own.join(F.broadcast(base), [*group, "part"]).withColumn("nth", F.col("base") + F.col("i")).drop("part", "i", "base")


def list_page(books: DataFrame, key: str, sets: str, token: str = "", setspec: str = "", chunk: int = CHUNK) -> tuple[DataFrame, str] | None:
    """One page of a list of books in order, and its resumption token element; None for a bad token or an empty page.

    token: ``offset`` or ``offset:set``, as an earlier page gave it. The page's bounds are pushed to the ranks, and only the list's size reaches the driver.
    """
    start = 0
    if token:
        found = re.fullmatch(r"(\d+)(?::(.*))?", token, re.S)
        if not found:
            return None
        start, setspec = int(found.group(1)), found.group(2) or setspec
    if setspec:
        books = books.where(F.array_contains(sets, setspec))
    size = books.count()
    if start >= size:
        return None
    return _cut(numbered(books, key), start, size, setspec, chunk)


def write_ranks(books: DataFrame, key: str, sets: str, path: str) -> None:
    """Keep a list's order: books with ``nth`` in the whole list under path/all, and each set's under path/sets with ``spec`` and ``nth`` in the set; sorted, so a page is a few row groups."""
    numbered(books, key).write.parquet(f"{path}/ranked")
    ranked = books.sparkSession.read.parquet(f"{path}/ranked")
    _kept(ranked, ["nth"], f"{path}/all")
    width = max(1, -(-ranked.count() // PARTS))
    every = ranked.select("*", F.explode(sets).alias("spec")).withColumnRenamed("nth", "in_all").withColumn("part", F.floor(F.col("in_all") / width))
    every.groupBy("spec").agg(F.count(F.lit(1)).alias("size")).write.parquet(f"{path}/sizes")
    _kept(_ranked(every, "in_all", "spec").drop("in_all"), ["spec", "nth"], f"{path}/sets")  # a set's books keep the list's order


def _kept(rows: DataFrame, order: list[str], path: str) -> None:
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.options(**{"parquet.block.size": str(1 << 20), "parquet.page.size": str(1 << 16)}).parquet(path)


def ranked_page(spark: SparkSession, path: str, token: str = "", setspec: str = "", chunk: int = CHUNK) -> tuple[DataFrame, str] | None:
    """list_page() of a list whose order write_ranks() kept: any page reads the rows of its own numbers and ranks nothing."""
    start = 0
    if token:
        found = re.fullmatch(r"(\d+)(?::(.*))?", token, re.S)
        if not found:
            return None
        start, setspec = int(found.group(1)), found.group(2) or setspec
    if setspec:
        rows = spark.read.parquet(f"{path}/sets").where(F.col("spec") == setspec).drop("spec")
        size = spark.read.parquet(f"{path}/sizes").where(F.col("spec") == setspec).agg(F.coalesce(F.max("size"), F.lit(0))).first()[0]
    else:
        rows = spark.read.parquet(f"{path}/all")
        size = rows.count()  # from the files' footers
    return _cut(rows, start, size, setspec, chunk) if start < size else None


def _cut(ranked: DataFrame, start: int, size: int, setspec: str, chunk: int) -> tuple[DataFrame, str]:
    after = start + chunk
    rest = (f"{after}:{setspec}" if setspec else str(after)) if after < size else ""
    head = f'<resumptionToken completeListSize="{size}" cursor="{start}"'
    return ranked.where((F.col("nth") >= start) & (F.col("nth") < after)), head + (f">{rest}</resumptionToken>" if rest else "/>")


def error_of(verb: str, prefix: str = "", identifier: bool | None = None, token: str = "", found: bool = True) -> str | None:
    """The protocol's error code of a request, or None. identifier: whether GetRecord's is known; found: whether a list has a page."""
    if verb in ("Identify", "ListMetadataFormats", "ListSets"):
        return None
    if verb in ("ListRecords", "ListIdentifiers"):
        if not token and prefix != "oai_dc":
            return "cannotDisseminateFormat"
        return None if found else "badResumptionToken" if token else "noRecordsMatch"
    if verb == "GetRecord":
        return "cannotDisseminateFormat" if prefix != "oai_dc" else None if identifier else "idDoesNotExist"
    return "badVerb"
