"""Catalogue fields, manifests, reading order and event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import catalogue as C
from quire.plans.registry import query
from quire.tables import corpus, table


@query(r"""WITH t AS (SELECT p_partkey, 'v. ' || (900 + p_partkey % 700) || ' [' || (1700 + p_partkey % 400) || ']' AS d FROM part),
n AS (SELECT p_partkey, 900 + p_partkey % 700 AS o, 1700 + p_partkey % 400 AS i FROM t)
SELECT p_partkey, CASE WHEN i BETWEEN 1600 AND 2029 THEN i WHEN o BETWEEN 1600 AND 2029 THEN o END::INT AS year_start,
list_min(list_filter([o, i], lambda y: y >= 1000 AND y NOT BETWEEN 1600 AND 2029))::INT AS year_hijri_start FROM n""")
def catalog_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    line = F.concat(F.lit("v. "), (900 + k % 700).cast("string"), F.lit(" ["), (1700 + k % 400).cast("string"), F.lit("]"))
    return table(spark, sf_dir, "part").select("p_partkey", C.years(line).alias("y")).select("p_partkey", "y.year_start", "y.year_hijri_start")


@query(r"""WITH n AS (SELECT p_partkey, [900 + p_partkey % 700, 900 + p_partkey % 700 + p_partkey % 3] AS o, CASE WHEN p_partkey % 4 > 0 THEN [1500 + p_partkey % 600, 1500 + p_partkey % 600 + p_partkey % 5] ELSE []::BIGINT[] END AS i FROM part),
g AS (SELECT p_partkey, list_filter(i, lambda y: y BETWEEN 1600 AND 2029) AS gi, list_filter(o, lambda y: y BETWEEN 1600 AND 2029) AS go, list_filter(list_concat(i, o), lambda y: y >= 1000 AND y NOT BETWEEN 1600 AND 2029) AS h FROM n)
SELECT p_partkey, list_min(CASE WHEN len(gi) > 0 THEN gi ELSE go END)::INT AS year_start, list_max(CASE WHEN len(gi) > 0 THEN gi ELSE go END)::INT AS year_end, list_min(h)::INT AS year_hijri_start, list_max(h)::INT AS year_hijri_end FROM g""")
def catalog_year_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both calendars' ranges of date lines with several years, in and out of brackets."""
    k, text = F.col("p_partkey"), lambda c: c.cast("string")
    o, i = 900 + k % 700, 1500 + k % 600
    bracket = F.when(k % 4 > 0, F.concat(F.lit(" ["), text(i), F.lit(" or "), text(i + k % 5), F.lit("]"))).otherwise("")
    line = F.concat(F.lit("Kabul "), text(o), F.lit(", "), text(o + k % 3), bracket)
    return table(spark, sf_dir, "part").select("p_partkey", C.years(line).alias("y")).select("p_partkey", "y.*")


@query("""WITH p AS (SELECT p_partkey, p_partkey % 5 AS k, p_name, p_brand FROM part)
SELECT p_partkey, CASE WHEN k = 0 THEN 'none=' WHEN k = 1 THEN 'fa=کتاب سراج' WHEN k = 2 THEN 'en=' || p_name || '|' || p_brand || ';fa=کتاب' ELSE 'en=' || p_name END AS languages FROM p""")
def language_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of a manifest's field by the language of their script."""
    k = F.col("p_partkey") % 5
    none = F.lit(None).cast("string")
    values = F.when(k == 0, F.array(F.lit(""), none)).when(k == 1, F.array(F.lit(" کتاب  سراج"))).when(k == 2, F.array(F.col("p_name"), F.concat(F.lit("کتاب "), "p_brand"))).otherwise(F.array(F.col("p_name"), none))
    entries = F.array_sort(F.map_entries(C.language_map(values)))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], "|"))), ";").alias("languages"))


@query("SELECT p_partkey, 'کتاب' AS fa, p_name AS en FROM part")
def title_script_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", C.split_script(F.concat(F.lit("کتاب "), "p_name")).alias("s")).select("p_partkey", "s.*")


@query("""SELECT source AS book, md5('{"id":"' || source || '","items":[' || string_agg('{"page":' || doc_id || '}', ',' ORDER BY doc_id) || ']}') AS manifest FROM documents GROUP BY source""")
def manifest_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A book's canvases in order; a manifest is one document, so its page numbers (not texts) come together."""
    items = F.array_sort(F.collect_list(F.struct("page")))
    return corpus(spark, sf_dir).groupBy("book").agg(items.alias("items")).select("book", F.md5(F.to_json(F.struct(F.col("book").alias("id"), "items")).cast("binary")).alias("manifest"))


@query("""WITH RECURSIVE b AS (SELECT user_id, event_id, value AS x, event_id % 1000 AS y, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id % 1000, event_id) AS k FROM events WHERE value IS NOT NULL),
s AS (SELECT user_id, event_id, k, y, x AS anchor, -1 AS col FROM b WHERE k = 1 UNION ALL
SELECT b.user_id, b.event_id, b.k, b.y, CASE WHEN abs(b.x - s.anchor) > 60 THEN b.x ELSE s.anchor END, CASE WHEN abs(b.x - s.anchor) > 60 THEN s.col - 1 ELSE s.col END FROM s JOIN b ON b.user_id = s.user_id AND b.k = s.k + 1)
SELECT user_id, string_agg(event_id::VARCHAR, ',' ORDER BY col, y, event_id) AS ids FROM s GROUP BY user_id""")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of a page (a user's events stand in) in right-to-left reading order."""
    e = table(spark, sf_dir, "events").where("value IS NOT NULL").select("user_id", F.struct(F.col("value").cast("double").alias("x"), (F.col("event_id") % 1000).cast("double").alias("y"), F.col("event_id").cast("long").alias("id")).alias("b"))
    return e.groupBy("user_id").agg(F.collect_list("b").alias("b")).select("user_id", F.concat_ws(",", C.reading_order(F.col("b"), 60.0).cast("array<string>")).alias("ids"))


@query("SELECT t + INTERVAL (30 * k) MINUTE AS began, event_type, count(*) AS n FROM (SELECT time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE AS t, event_type FROM events), (VALUES (0), (1)) v(k) GROUP BY ALL")
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("ts", "1 hour", "30 minutes").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("began"), "event_type", "n")


@query("SELECT o_orderkey, CASE WHEN y2 <> y THEN y || '–' || y2 ELSE y::VARCHAR END AS text FROM (SELECT o_orderkey, year(o_orderdate) AS y, year(o_orderdate) + o_orderkey % 2 AS y2 FROM orders)")
def date_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.year("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", C.date_text(y, (y + F.col("o_orderkey") % 2)).alias("text"))
