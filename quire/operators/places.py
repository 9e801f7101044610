"""The place index: a gazetteer's entries merged by name, and their phrases found on pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T

SAMPLE = 200


def fold(t: Column) -> Column:
    return T.fold_search(t, False, True)


def merged(places: DataFrame, admin: list[str]) -> DataFrame:
    """places(id, name, feature, population, variants, pos): one row a folded name.

    The representative has most people, of equals an administrative seat, then the first; variants are a sorted union, and merged_ids the
    others in their order.
    """
    rank = F.struct("population", F.col("feature").isin(admin).alias("is_admin"), (-F.col("pos")).alias("p"))
    grouped = places.groupBy(fold(F.col("name")).alias("key")).agg(F.max_by(F.struct("id", "name", "feature", "population"), rank).alias("best"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("variants")))).alias("variants"), F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("every"))
    return grouped.select("key", "best.*", "variants", F.filter(F.transform("every", lambda x: x["id"]), lambda i: i != F.col("best.id")).alias("merged_ids"))


def phrases(places: DataFrame, stop: list[str]) -> DataFrame:
    """(phrase, id): folded variants of 4 characters or more without blanks that are no stop words."""
    p = places.select("id", F.explode("variants").alias("v")).select("id", fold(F.col("v")).alias("phrase"))
    folded = [r["w"] for r in places.sparkSession.createDataFrame([(w,) for w in stop] or [("",)], "w string").select(fold(F.col("w")).alias("w")).collect()]
    return p.where((F.length(F.replace("phrase", F.lit(" "))) >= 4) & ~F.col("phrase").isin(folded)).distinct()


def by_id(merged: DataFrame, wanted: object) -> DataFrame:
    """The place of a number, or no row; a place that was merged into another is found under that one's number only."""
    return merged.where(F.col("id") == F.lit(wanted))


def place_index(hits: DataFrame) -> DataFrame:
    """(id, pages, books, sample): the sample is the first 200 places of an entry by book and page, found by rank and never from a list of all."""
    from pyspark.sql import Window

    counts = hits.groupBy("id").agg(F.count(F.lit(1)).alias("pages"), F.countDistinct("book").alias("books"))
    first = hits.withColumn("i", F.row_number().over(Window.partitionBy("id").orderBy("book", "page"))).where(F.col("i") <= SAMPLE)
    sample = first.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("book", "page"))).alias("sample"))
    return counts.join(sample, "id")
