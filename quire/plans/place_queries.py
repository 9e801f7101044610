"""Gazetteer merging and phrase matching, contributions and their visibility."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import places as P
from quire.operators.phrases import found
from quire.plans.corpus_queries import fold_sql
from quire.plans.registry import query
from quire.tables import table

_STOP = ["the of", "that"]
#: A gazetteer of the benchmark's words: entries named by a passage's first word, with its first one, two and three words as variants.
_PLACES = f"""w AS (SELECT item_id AS id, item_id AS pos, list_filter(string_split({fold_sql('text')}, ' '), lambda x: x <> '') AS w FROM benchmark),
places AS (SELECT id, pos, w[1] AS name, CASE WHEN id % 3 = 0 THEN 'PPLA' ELSE 'PPL' END AS feature, (id % 4) * 1000 AS population, list_distinct([w[2], w[1] || ' ' || w[2], array_to_string(w[1:3], ' ')]) AS variants FROM w WHERE len(w) >= 3),
ranked AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY population DESC, feature = 'PPLA' DESC, pos) AS r FROM places),
merged AS (SELECT name AS key, min(id) FILTER (r = 1) AS id, list_sort(list_distinct(flatten(list(variants)))) AS variants, coalesce(list(id ORDER BY pos) FILTER (r > 1), []) AS merged_ids FROM ranked GROUP BY name),
phrases AS (SELECT DISTINCT id, v AS phrase FROM (SELECT id, unnest(variants) AS v FROM merged) WHERE length(replace(v, ' ', '')) >= 4 AND v NOT IN ('the of', 'that'))"""


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").select("item_id", F.filter(F.split(P.fold(F.col("text")), " "), lambda x: x != "").alias("w")).where(F.size("w") >= 3)
    at = lambda a, b: F.array_join(F.slice("w", a, b), " ")
    return b.select(F.col("item_id").alias("id"), F.col("item_id").alias("pos"), F.get("w", 0).alias("name"), F.when(F.col("item_id") % 3 == 0, "PPLA").otherwise("PPL").alias("feature"), ((F.col("item_id") % 4) * 1000).alias("population"), F.array_distinct(F.array(at(2, 1), at(1, 2), at(1, 3))).alias("variants"))


@query(f"WITH {_PLACES} SELECT key, id, array_to_string(variants, '|') AS variants, array_to_string(merged_ids, ',') AS merged_ids FROM merged")
def merge_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = P.merged(_places(spark, sf_dir), ["PPLA", "PPLC"])
    return m.select("key", "id", F.array_join("variants", "|").alias("variants"), F.array_join(F.col("merged_ids").cast("array<string>"), ",").alias("merged_ids"))


_FOUND = f"""{_PLACES}, d AS (SELECT doc_id, source, list_filter(string_split({fold_sql('text')}, ' '), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, source, unnest(list_distinct(flatten([w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])]))) AS phrase FROM d),
hits AS (SELECT DISTINCT id, source AS book, doc_id AS page FROM g JOIN phrases USING (phrase))"""


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "documents").select(F.col("source").alias("book"), F.col("doc_id").alias("page"), P.fold(F.col("text")).alias("txt"))
    return found(pages, P.phrases(P.merged(_places(spark, sf_dir), ["PPLA", "PPLC"]), _STOP))


@query(f"WITH {_FOUND} SELECT id, book, page FROM hits")
def phrase_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages on which a place's phrases of one to three words stand."""
    return _hits(spark, sf_dir)


@query(f"WITH {_FOUND} SELECT id AS place, count(*) AS pages, count(DISTINCT book) AS books, md5(array_to_string(list(book || '/' || page ORDER BY book, page)[1:200], ',')) AS sample FROM hits GROUP BY id")
def place_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places with their pages, books and first 200 pages."""
    i = P.place_index(_hits(spark, sf_dir))
    sample = F.array_join(F.transform("sample", lambda x: F.concat_ws("/", x["book"], x["page"].cast("string"))), ",")
    return i.select(F.col("id").alias("place"), "pages", "books", F.md5(sample.cast("binary")).alias("sample"))


@query(f"WITH {_FOUND} SELECT id, pages, books, rank FROM (SELECT id, count(*) AS pages, count(DISTINCT book) AS books, row_number() OVER (ORDER BY count(*) DESC, id) AS rank FROM hits GROUP BY id) WHERE rank <= 20")
def place_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places with most pages, without their samples."""
    from pyspark.sql import Window

    top = P.place_index(_hits(spark, sf_dir)).drop("sample").orderBy(F.desc("pages"), "id").limit(20)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("pages"), "id")))


@query(f"WITH {_PLACES} SELECT id, key AS name, array_to_string(variants, '|') AS variants FROM merged WHERE id = (SELECT max(id) FROM merged)")
def place_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One place by its number."""
    m = P.merged(_places(spark, sf_dir), ["PPLA", "PPLC"])
    wanted = m.agg(F.max("id")).first()[0]
    return P.by_id(m, wanted).select("id", F.col("key").alias("name"), F.array_join("variants", "|").alias("variants"))


#: Contributions made from events: corrections, notes and annotations of users, some approved.
_KIND = "CASE event_id % 3 WHEN 0 THEN 'correction' WHEN 1 THEN 'note' ELSE 'annotation' END"
_STATUS = "CASE WHEN event_id % 3 = 2 THEN 'private' WHEN event_id % 5 < 2 THEN 'approved' ELSE 'pending' END"


def _contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n"))
    return table(spark, sf_dir, "events").crossJoin(F.broadcast(n)).select("event_id", "user_id", "ts", (F.col("event_id") % F.col("n")).alias("page"), F.expr(_KIND).alias("kind"), F.expr(_STATUS).alias("status"), F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("@x")).alias("email"))


@query(f"SELECT event_id, kind FROM (SELECT event_id, user_id, {_KIND} AS kind, {_STATUS} AS status FROM events) WHERE (kind = 'correction' AND status = 'approved') OR user_id = 8")
def contrib_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What user 8 sees: everyone's approved corrections and all of their own."""
    return _contributions(spark, sf_dir).where(((F.col("kind") == "correction") & (F.col("status") == "approved")) | (F.col("user_id") == 8)).select("event_id", "kind")


@query(f"SELECT event_id, user_id, event_id % (SELECT count(*) FROM documents) AS page, {_KIND} AS kind, {_STATUS} AS status FROM events WHERE user_id = 8")
def contrib_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's own rows, whole but for the address."""
    return _contributions(spark, sf_dir).where("user_id = 8").drop("email", "ts")


@query("SELECT event_id, user_id IN (3, 8, 21) AS allowed FROM events WHERE event_type = 'click'")
def moderation_rights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a moderating request comes from a moderator: a short list decides."""
    rights = spark.createDataFrame([(3,), (8,), (21,)], "moderator long")
    e = table(spark, sf_dir, "events").where("event_type = 'click'")
    return e.join(F.broadcast(rights), F.col("user_id") == F.col("moderator"), "left").select("event_id", F.col("moderator").isNotNull().alias("allowed"))
