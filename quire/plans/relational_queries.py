"""Joins, set operations, windows, resume logic, facets, paired statistics and cost over the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import metrics as M
from quire.functions import text as T
from quire.plans.registry import query
from quire.tables import table


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(spark, sf_dir, name)


@query("SELECT d.doc_id, d.source AS book FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def resume_anti(spark, sf_dir):
    """Work that is left: what has no result yet."""
    return _t(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("book")).join(_t(spark, sf_dir, "labels"), "doc_id", "left_anti")


@query("SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 5")
def first_n_per_group(spark, sf_dir):
    w = Window.partitionBy("source").orderBy("doc_id")
    return _t(spark, sf_dir, "documents").select("source", "doc_id").withColumn("rn", F.row_number().over(w)).where("rn <= 5").drop("rn")


@query("SELECT min(doc_id) AS doc_id, md5(text) AS body, count(*) - 1 AS dropped FROM documents GROUP BY text")
def dedupe_first(spark, sf_dir):
    """First row of each key, and how many later ones go. Keys are digests, so texts aren't shuffled."""
    return _t(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("body")).groupBy("body").agg(F.min("doc_id").alias("doc_id"), (F.count(F.lit(1)) - 1).alias("dropped"))


@query("SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 200 AS chunk FROM documents")
def chunk_assign(spark, sf_dir):
    """Chunks of 200 rows in key order. Ranks come from range parts and their sizes, not from one sorted partition."""
    d = _t(spark, sf_dir, "documents").select("doc_id")
    return global_rank(d, "doc_id").select("doc_id", F.floor((F.col("rank") - 1) / 200).alias("chunk"))


def running(df: DataFrame, key: str, value) -> DataFrame:
    """Add running, the sum of value up to each row in key order: within range parts by a window, across them by prefix sums."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges = df.agg(F.percentile_approx(key, [i / n for i in range(1, n)] or [0.5], 10_000).alias("p")).first()["p"] or []
    part = F.size(F.filter(F.array(*[F.lit(e) for e in sorted(set(edges))]), lambda e: e < F.col(key))) if edges else F.lit(0)
    parted = df.withColumns({"__part": part, "__v": value})
    sums = parted.groupBy("__part").agg(F.sum("__v").alias("__s"))
    before = sums.withColumn("__base", F.coalesce(F.sum("__s").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__s")
    inside = F.sum("__v").over(Window.partitionBy("__part").orderBy(key).rowsBetween(Window.unboundedPreceding, 0))
    return parted.withColumn("__in", inside).join(F.broadcast(before), "__part").withColumn("running", F.col("__in") + F.col("__base")).drop("__part", "__in", "__base", "__v")


def at_ranks(df: DataFrame, group: str, x: str, quarters: dict[str, int]) -> DataFrame:
    """(group, n and a value for each name): the element at n * quarter // 4 of a group's sorted values.

    Equal values are one row before they are ranked, and ranks come from ranges of values and their prefix sums, so a group needs no task of its own.
    """
    counted = df.where(F.col(x).isNotNull()).groupBy(group, x).agg(F.count(F.lit(1)).alias("k"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges = sorted(set(df.agg(F.percentile_approx(x, [i / parts for i in range(1, parts)] or [0.5], 10_000).alias("p")).first()["p"] or []))
    parted = counted.withColumn("part", F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e < F.col(x))) if edges else F.lit(0))
    sums = parted.groupBy(group, "part").agg(F.sum("k").alias("s"))
    base = sums.select(group, "part", F.coalesce(F.sum("s").over(Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    upto = F.col("base") + F.sum("k").over(Window.partitionBy(group, "part").orderBy(x).rowsBetween(Window.unboundedPreceding, 0))
    sizes = sums.groupBy(group).agg(F.sum("s").alias("n"))
    ranked = parted.join(base, [group, "part"]).withColumn("upto", upto).join(F.broadcast(sizes), group)
    at = lambda q: F.max(F.when((F.floor(F.col("n") * q / 4) < F.col("upto")) & (F.floor(F.col("n") * q / 4) >= F.col("upto") - F.col("k")), F.col(x)))
    return ranked.groupBy(group).agg(F.max("n").alias("n"), *[at(q).alias(name) for name, q in quarters.items()])


def global_rank(df: DataFrame, key: str) -> DataFrame:
    """Add rank, 1 to n in key order."""
    return running(df, key, F.lit(1)).withColumnRenamed("running", "rank")


@query("""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents)
SELECT doc_id FROM r WHERE i IN (SELECT (k * n) // 50 FROM range(50) t(k), (SELECT count(*) AS n FROM documents))""")
def even_subsample(spark, sf_dir):
    """50 rows, evenly over the order."""
    d = _t(spark, sf_dir, "documents").select("doc_id")
    n = d.agg(F.count(F.lit(1)).alias("n"))
    wanted = spark.range(50).crossJoin(F.broadcast(n)).select((F.floor(F.col("id") * F.col("n") / 50) + 1).cast("long").alias("rank")).distinct()
    return global_rank(d, "doc_id").join(F.broadcast(wanted), "rank", "left_semi").select("doc_id")


@query("SELECT doc_id, source FROM documents WHERE (source, doc_id % 7) IN (('src1', 1), ('src2', 3), ('src5', 0))")
def tuple_semi(spark, sf_dir):
    keys = spark.createDataFrame([("src1", 1), ("src2", 3), ("src5", 0)], "source string, m long")
    return _t(spark, sf_dir, "documents").select("doc_id", "source", (F.col("doc_id") % 7).alias("m")).join(F.broadcast(keys), ["source", "m"], "left_semi").select("doc_id", "source")


@query("SELECT doc_id, arm FROM labels, (VALUES ('a'), ('b'), ('c')) v(arm)")
def cross_arms(spark, sf_dir):
    """Rows by arms: an array of the few arms, exploded."""
    return _t(spark, sf_dir, "labels").select("doc_id", F.explode(F.array(*[F.lit(x) for x in "abc"])).alias("arm"))


_ARMS = "SELECT l_orderkey AS page, l_returnflag AS arm, avg(l_discount) AS cer, avg(l_quantity) AS yield FROM lineitem GROUP BY ALL"


def _arms(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("page"), F.col("l_returnflag").alias("arm")).agg(F.avg("l_discount").alias("cer"), F.avg("l_quantity").alias("yield"))


@query(f"""SELECT a.page, round(a.yield - b.yield, 6) AS delta FROM ({_ARMS}) a JOIN ({_ARMS}) b ON a.page = b.page AND a.arm = 'A' AND b.arm = 'R'""")
def paired_delta(spark, sf_dir):
    """Differences on pages that both arms scored: one aggregation, no self-join."""
    p = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("page")).agg(*[F.avg(F.when(F.col("l_returnflag") == a, F.col("l_quantity"))).alias(a) for a in "AR"])
    return p.where("A IS NOT NULL AND R IS NOT NULL").select("page", F.round(F.col("A") - F.col("R"), 6).alias("delta"))


@query("SELECT l_orderkey AS page FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 3")
def common_scored(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("page")).agg(F.countDistinct("l_returnflag").alias("n")).where("n = 3").select("page")


@query(f"""WITH p AS (SELECT a.yield - b.yield AS d FROM ({_ARMS}) a JOIN ({_ARMS}) b ON a.page = b.page AND a.arm = 'A' AND b.arm = 'R'),
c AS (SELECT count(*) FILTER (d > 0) AS wins, count(*) FILTER (d <> 0) AS n FROM p)
SELECT wins, n, round(least(1.0, 2 * (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))) FROM range(0, 5000) r(i) WHERE i <= least(wins, n - wins))), 6) AS p, CASE WHEN 2 * wins > n THEN 'better' WHEN 2 * wins < n THEN 'worse' ELSE 'tie' END AS direction FROM c""")
def sign_test(spark, sf_dir):
    d = paired_delta(spark, sf_dir).agg(F.count_if(F.col("delta") > 0).alias("wins"), F.count_if(F.col("delta") != 0).alias("n"))
    w, n = F.col("wins"), F.col("n")
    return d.select("wins", "n", F.round(M.sign_test(n, w), 6).alias("p"), F.when(2 * w > n, "better").when(2 * w < n, "worse").otherwise("tie").alias("direction"))


@query("""SELECT l_shipmode_arm AS arm, count(*) AS calls, count(cer) AS scored, count(*) - count(cer) AS errors, round(avg(cer), 6) AS mean_cer, round(median(cer), 6) AS median_cer, round(sum(usd), 4) AS usd
FROM (SELECT l_linestatus || l_returnflag AS l_shipmode_arm, CASE WHEN l_discount > 0.0 THEN l_discount END AS cer, (l_quantity * 1.0 + l_tax * 6.0) / 1e6 AS usd FROM lineitem) GROUP BY 1""")
def arm_summary(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").select(F.concat("l_linestatus", "l_returnflag").alias("arm"), F.when(F.col("l_discount") > 0, F.col("l_discount")).alias("cer"), M.usd(F.col("l_quantity"), F.col("l_tax"), F.lit(1.0), F.lit(6.0)).alias("usd"))
    return li.groupBy("arm").agg(F.count(F.lit(1)).alias("calls"), F.count("cer").alias("scored"), (F.count(F.lit(1)) - F.count("cer")).alias("errors"), F.round(F.avg("cer"), 6).alias("mean_cer"), F.round(F.median("cer"), 6).alias("median_cer"), F.round(F.sum("usd"), 4).alias("usd"))


@query("""SELECT l_returnflag AS arm, n, c[n // 4 + 1] AS q1, c[n // 2 + 1] AS q2, c[3 * n // 4 + 1] AS q3 FROM (SELECT l_returnflag, count(*) AS n, list_sort(list(l_extendedprice)) AS c FROM lineitem GROUP BY 1)""")
def quartile_summary(spark, sf_dir):
    """Elements at n/4, n/2 and 3n/4 of the sorted values, not interpolated: values are counted first, and counts summed in order within ranges of values."""
    li = _t(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("arm"), F.col("l_extendedprice").alias("x"))
    return at_ranks(li, "arm", "x", {"q1": 1, "q2": 2, "q3": 3})


@query("SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL")
def tally(spark, sf_dir):
    return _t(spark, sf_dir, "labels").groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_orderkey, sum(c) OVER (ORDER BY l_orderkey)::BIGINT AS running FROM (SELECT l_orderkey, sum(round((l_quantity + l_tax * 6) * 100)::BIGINT) AS c FROM lineitem GROUP BY 1)")
def running_cost(spark, sf_dir):
    c = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(F.round((F.col("l_quantity") + F.col("l_tax") * 6) * 100).cast("long")).alias("c"))
    return running(c, "l_orderkey", F.col("c")).select("l_orderkey", "running")


@query("""SELECT event_id, greatest(c + t, total - p, c) AS output, round((p * 1.25 + greatest(c + t, total - p, c) * 10.0) / 1e6, 9) AS usd FROM (SELECT event_id, event_id % 900 AS c, coalesce(CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 50 END, 0) AS t, event_id % 2000 AS total, event_id % 700 AS p FROM events)""")
def cost_usage(spark, sf_dir):
    i = F.col("event_id")
    e = _t(spark, sf_dir, "events").select("event_id", M.output_tokens(i % 900, F.when(i % 3 == 0, None).otherwise(i % 50), i % 2000, i % 700).alias("output"))
    return e.withColumn("usd", F.round(M.usd(i % 700, F.col("output"), F.lit(1.25), F.lit(10.0)), 9))


@query("SELECT (year(o_orderdate) // 10) * 10 AS decade, count(*) AS books, sum(o_shippriority_pages)::BIGINT AS pages FROM (SELECT o_orderdate, o_orderkey % 97 AS o_shippriority_pages FROM orders) GROUP BY 1")
def facet_decade(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    return o.groupBy((F.floor(F.year("o_orderdate") / 10) * 10).alias("decade")).agg(F.count(F.lit(1)).alias("books"), F.sum(F.col("o_orderkey") % 97).alias("pages"))


@query("SELECT trim(split_part(p_type, ' ', 1)) AS subject, count(*) AS n FROM part WHERE trim(split_part(p_type, ' ', 1)) <> '' GROUP BY 1")
def facet_subject(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select(F.trim(F.split_part("p_type", F.lit(" "), F.lit(1))).alias("subject"))
    return p.where("subject <> ''").groupBy("subject").agg(F.count(F.lit(1)).alias("n"))


@query(r"SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part")
def slug(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", T.slug(F.col("p_name")).alias("slug"))


@query("SELECT p_partkey, p_brand AS title FROM part WHERE p_size < 10 ORDER BY lower(coalesce(nullif(p_brand, ''), chr(65535))), p_partkey LIMIT 100")
def facet_titles(spark, sf_dir):
    return _t(spark, sf_dir, "part").where("p_size < 10").orderBy(F.lower(F.coalesce(F.nullif("p_brand", F.lit("")), F.lit("￿"))), "p_partkey").limit(100).select("p_partkey", F.col("p_brand").alias("title"))


@query("SELECT p_partkey, concat_ws('. ', nullif(rtrim(p_brand, '.'), ''), nullif(rtrim(p_name, '.'), ''), nullif(rtrim(p_type, '.'), '')) || '.' AS citation FROM part")
def citation(spark, sf_dir):
    part = lambda c: F.nullif(F.regexp_replace(c, r"\.+$", ""), F.lit(""))
    return _t(spark, sf_dir, "part").select("p_partkey", F.concat(F.concat_ws(". ", part("p_brand"), part("p_name"), part("p_type")), F.lit(".")).alias("citation"))


@query("""SELECT conv_id, turn, lag(role) OVER w AS before, lead(role) OVER w AS after, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS so_far FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def lag_lead_turns(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.lag("role").over(w).alias("before"), F.lead("role").over(w).alias("after"), F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("so_far"))


@query("SELECT 'both' AS part, k FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'customer', k FROM (SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier)")
def union_intersect_except(spark, sf_dir):
    c, s = _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    return c.intersect(s).select(F.lit("both").alias("part"), "k").unionByName(c.exceptAll(s).join(s, "k", "left_anti").distinct().select(F.lit("customer").alias("part"), "k"))


@query("SELECT d.doc_id, coalesce(b.text, d.text) AS text FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id")
def replace_by_key(spark, sf_dir):
    """All texts, whole; where there is a repaired text it takes the old one's place."""
    b = _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("new"))
    return _t(spark, sf_dir, "documents").select("doc_id", "text").join(b, "doc_id", "left").select("doc_id", F.coalesce("new", "text").alias("text"))


@query("""WITH e AS (SELECT event_id, event_type IN ('click', 'view') AS blank, value AS v FROM events WHERE value IS NOT NULL), k AS (SELECT min(v) AS least FROM e WHERE NOT blank),
t AS (SELECT DISTINCT v FROM e) SELECT count(*) FILTER (blank AND v < least) AS found, count(*) FILTER (blank) AS blanks, count(*) FILTER (NOT blank AND v < least) AS lost FROM e, k""")
def threshold_zero_fp(spark, sf_dir):
    """Blank rows that the largest threshold without a lost row finds."""
    e = _t(spark, sf_dir, "events").where("value IS NOT NULL").select(F.col("event_type").isin("click", "view").alias("blank"), F.col("value").alias("v"))
    least = e.where("NOT blank").agg(F.min("v").alias("least"))
    return e.crossJoin(F.broadcast(least)).agg(F.count_if(F.expr("blank AND v < least")).alias("found"), F.count_if("blank").alias("blanks"), F.count_if(F.expr("NOT blank AND v < least")).alias("lost"))


@query("""SELECT user_id, event_type AS verdict FROM (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first FROM events GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first) = 1""")
def vote_majority(spark, sf_dir):
    """Most common verdict of each group; ties go to the one seen first."""
    v = _t(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"))
    return v.groupBy("user_id").agg(F.max_by("event_type", F.struct("n", -F.col("first"))).alias("verdict"))


@query("""SELECT event_id, left(trim(event_type), 4000) AS body, CASE WHEN event_type NOT IN ('click', 'view', 'purchase') THEN 'rejected' WHEN event_type = 'purchase' AND value < 50 THEN 'needs licence' WHEN event_type = 'view' THEN 'private' ELSE 'pending' END AS status FROM events""")
def contrib_validate(spark, sf_dir):
    """Validation of contributions: kind, licence, and what is shown to whom."""
    k, v = F.col("event_type"), F.col("value")
    status = F.when(~k.isin("click", "view", "purchase"), "rejected").when((k == "purchase") & (v < 50), "needs licence").when(k == "view", "private").otherwise("pending")
    return _t(spark, sf_dir, "events").select("event_id", F.left(F.trim("event_type"), F.lit(4000)).alias("body"), status.alias("status"))


@query("""SELECT d.doc_id, c.latest FROM documents d LEFT JOIN (SELECT doc_id, arg_max(event_id, (ts, event_id)) AS latest FROM (SELECT event_id % (SELECT count(*) FROM documents) AS doc_id, event_id, ts FROM events WHERE event_type = 'click') GROUP BY 1) c USING (doc_id)""")
def contrib_overlay(spark, sf_dir):
    """Pages with the latest approved correction, which never changes the page itself."""
    d = _t(spark, sf_dir, "documents").select("doc_id")
    e = _t(spark, sf_dir, "events").where("event_type = 'click'").crossJoin(F.broadcast(d.agg(F.count(F.lit(1)).alias("n"))))
    c = e.groupBy((F.col("event_id") % F.col("n")).alias("doc_id")).agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("latest"))
    return d.join(c, "doc_id", "left")


@query("SELECT event_id, user_id FROM events WHERE event_type = 'click' ORDER BY ts, event_id LIMIT 200")
def moderation_queue(spark, sf_dir):
    return _t(spark, sf_dir, "events").where("event_type = 'click'").orderBy("ts", "event_id").limit(200).select("event_id", "user_id")
