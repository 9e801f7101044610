"""Silver labels, evaluation, judging, layout votes, blank detection, cost and worklists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import layout as L
from quire.functions import metrics as M
from quire.operators import gold as G
from quire.plans.corpus_queries import in_bytes
from quire.plans.registry import query
from quire.tables import table

#: Readings of benchmark passages by three readers: as they are, with letters swapped, and cut; kinds are their code points, for the SQL side's distance counts bytes.
_CLEAN = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"
_READS = f"""reads AS (SELECT item_id AS key, pos, reader, CASE reader WHEN 'a' THEN t WHEN 'b' THEN replace(t, 'th', 'ht') ELSE CASE WHEN item_id % 5 = 0 THEN '' ELSE left(t, (length(t) * (30 + item_id % 70)) // 100) END END AS t, kinds
FROM (SELECT item_id, {_CLEAN} AS t, list_distinct(string_split({_CLEAN} || 'ht lead and a tail that the reference lacks altogether', '')) AS kinds FROM benchmark), (VALUES (0, 'a'), (1, 'b'), (2, 'c')) v(pos, reader))"""


def _reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("key"), F.trim(F.regexp_replace("text", r"\s+", " ")).alias("t"))
    readers = F.explode(F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(r).alias("reader")) for i, r in enumerate("abc")])).alias("v")
    cut = F.expr("left(t, cast(floor(length(t) * (30 + key % 70) / 100) as int))")
    text = F.when(F.col("v.reader") == "a", F.col("t")).when(F.col("v.reader") == "b", F.replace("t", F.lit("th"), F.lit("ht"))).otherwise(F.when(F.col("key") % 5 == 0, "").otherwise(cut))
    return b.select("key", "t", readers).select("key", "v.pos", "v.reader", text.alias("t"))


@query(f"""WITH {_READS}, r AS (SELECT * FROM reads WHERE trim(t) <> ''), pairs AS (SELECT a.key, a.reader AS ra, b.reader AS rb, a.t AS ta, b.t AS tb, a.pos AS pa, b.pos AS pb, 1 - levenshtein({in_bytes('a.t', 'a.kinds')}, {in_bytes('b.t', 'a.kinds')}) / greatest(length(a.t), length(b.t)) AS s FROM r a JOIN r b ON a.key = b.key AND a.pos < b.pos),
best AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY key ORDER BY s DESC, pa, pb) = 1)
SELECT key, CASE WHEN s >= 0.9 THEN 'silver' ELSE 'vendor_disagreement' END AS outcome, CASE WHEN s >= 0.9 THEN md5(CASE WHEN length(ta) >= length(tb) THEN ta ELSE tb END) END AS ref, round(s, 6) AS confidence, ra || ',' || rb AS sources FROM best
UNION ALL SELECT key, 'insufficient_reads', NULL, NULL, NULL FROM (SELECT key, count(*) FILTER (trim(t) <> '') AS n FROM reads GROUP BY key) WHERE n < 2""")
def silver_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = G.silver(_reads(spark, sf_dir), "key", "reader", "t", "pos", 0.9)
    return s.select("key", "outcome", F.md5(F.col("ref").cast("binary")).alias("ref"), F.round("confidence", 6).alias("confidence"), F.array_join("sources", ",").alias("sources"))


_SCORED = f"""{_READS}, gold AS (SELECT key, t AS ref, kinds FROM reads WHERE reader = 'a' AND t <> ''),
scored AS (SELECT reader, g.key, CASE WHEN g.key % 11 = 0 THEN NULL ELSE levenshtein({in_bytes("left(coalesce(r.t, ''), 8000)", 'g.kinds')}, {in_bytes('left(ref, 8000)', 'g.kinds')}) / length(left(ref, 8000)) END AS cer, g.key % 11 = 0 AS failed FROM gold g CROSS JOIN (VALUES ('a'), ('b'), ('c')) v(reader) LEFT JOIN reads r USING (key, reader))"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = _reads(spark, sf_dir)
    gold = reads.where("reader = 'a' AND t <> ''").select("key", F.col("t").alias("ref"))
    every = gold.crossJoin(F.broadcast(spark.createDataFrame([("a",), ("b",), ("c",)], "reader string")))
    met = every.join(reads.select("key", "reader", "t"), ["key", "reader"], "left")
    failed = F.col("key") % 11 == 0
    return met.select("reader", "key", F.when(~failed, M.cer(F.coalesce("t", F.lit("")), F.col("ref"))).alias("cer"), failed.alias("failed"))


@query(f"WITH {_SCORED} SELECT reader, count(cer) AS n, count(*) FILTER (failed) AS errors, round(avg(cer), 6) AS cer_mean, round(median(cer), 6) AS cer_median FROM scored GROUP BY reader")
def bench_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = G.bench_summary(_scored(spark, sf_dir), "reader", "cer", "failed")
    return s.withColumns({c: F.round(c, 6) for c in ("cer_mean", "cer_median")})


@query(f"WITH {_SCORED} SELECT reader, row_number() OVER (ORDER BY avg(cer) NULLS LAST, reader) AS place FROM scored GROUP BY reader")
def reader_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readers by their mean error, those without one last; readers are few, so one window ranks them."""
    m = _scored(spark, sf_dir).groupBy("reader").agg(F.avg("cer").alias("m"))
    return m.select("reader", F.row_number().over(Window.orderBy(F.col("m").asc_nulls_last(), "reader")).alias("place"))


@query(f"""WITH {_READS}, p AS (SELECT a.key, b.t AS pred, a.t AS ref, length(a.t) AS n, a.kinds FROM reads a JOIN reads b ON a.key = b.key AND a.reader = 'a' AND b.reader = 'b'),
q AS (SELECT key, 'lead ' || pred || ' and a tail that the reference lacks altogether' AS pred, left(ref, n // 2) AS ref, kinds FROM p),
w AS (SELECT key, {in_bytes('pred', 'kinds')} AS pred, {in_bytes('ref', 'kinds')} AS ref, length(ref) AS n, greatest(1, length(ref) // 8) AS step FROM q)
SELECT key, CASE WHEN n >= 40 AND length(pred) >= 40 THEN round((SELECT min(levenshtein(substr(pred, i + 1, (n * 13) // 10), ref) / n) FROM range(0, greatest(1, length(pred) - n), step) r(i)), 6) END AS cer FROM w""")
def best_window_cer(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _reads(spark, sf_dir)
    p = r.where("reader = 'a'").select("key", F.col("t").alias("ref")).join(r.where("reader = 'b'").select("key", F.col("t").alias("pred")), "key")
    q = p.select("key", F.concat(F.lit("lead "), "pred", F.lit(" and a tail that the reference lacks altogether")).alias("pred"), F.expr("left(ref, cast(floor(length(ref) / 2) as int))").alias("ref"))
    return q.select("key", F.round(G.best_window(F.col("pred"), F.col("ref")), 6).alias("cer"))


#: Judges' replies made from events: objects, lists, and text that is neither.
_REPLY = """CASE WHEN event_id % 7 = 0 THEN 'no answer' WHEN event_id % 5 = 0 THEN '[{"verdict": "' || v || '", "confidence": ' || c || '}]' WHEN event_id % 4 = 0 THEN '{"verdict": "' || v || '"}' ELSE '{"verdict": "' || v || '", "confidence": ' || c || ', "evidence": "x"}' END"""


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("value IS NOT NULL")
    v = F.when(F.col("event_type") == "click", "same").when(F.col("event_type") == "view", "different").otherwise("unsure")
    e = e.select("event_id", "user_id", v.alias("v"), ((F.col("event_id") * 37) % 101).alias("n")).withColumn("c", F.concat(F.lit("0."), F.lpad(F.col("n").cast("string"), 3, "0")))
    return e.select("event_id", "user_id", F.expr(_REPLY).alias("reply"))


_V = "CASE event_type WHEN 'click' THEN 'same' WHEN 'view' THEN 'different' ELSE 'unsure' END"
_JUDGED = f"""judged AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'uncertain' ELSE {_V} END AS verdict, CASE WHEN event_id % 7 = 0 THEN 0.0 WHEN event_id % 5 = 0 THEN ((event_id * 37) % 101) / 1000.0 WHEN event_id % 4 = 0 THEN 0.0 ELSE ((event_id * 37) % 101) / 1000.0 END::DOUBLE AS confidence FROM events WHERE value IS NOT NULL)"""


@query(f"WITH {_JUDGED} SELECT verdict, count(*) AS n, count(*) FILTER (verdict = 'same' AND confidence >= 0.07) AS gold FROM judged GROUP BY verdict")
def judge_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies read as verdicts and told; what is accepted as gold."""
    j = _judged(spark, sf_dir).select(L.verdict(F.col("reply")).alias("j")).select("j.*")
    return j.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("verdict") == "same") & (F.col("confidence") >= 0.07)).alias("gold"))


@query(f"WITH {_JUDGED} SELECT event_id, verdict, round(confidence, 6) AS confidence FROM judged WHERE verdict IN ('uncertain', 'different')")
def human_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a person should look at, the surest first."""
    j = _judged(spark, sf_dir).select("event_id", L.verdict(F.col("reply")).alias("j")).select("event_id", "j.*").where(F.col("verdict").isin("uncertain", "different"))
    return j.orderBy(F.desc("confidence"), "event_id").withColumn("confidence", F.round("confidence", 6))


#: Three layout replies for each user: a class, and as many regions as the event says, one in six without a whole box.
_CLASS = "CASE WHEN event_type IN ('click', 'view') THEN 'independent_prose' WHEN event_type = 'purchase' THEN 'paired_verse' ELSE 'none' END"
_RUNS = f"""runs AS (SELECT user_id, event_id, {_CLASS} AS cls, len(list_filter(range(0, event_id % 30), lambda i: i % 6 <> 5)) AS regions FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 3)"""


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "events").withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))).where("n <= 3")
    region = lambda i: F.concat(F.lit('{"order": '), (29 - i).cast("string"), F.lit(', "type": "text", "box": '), F.when(i % 6 == 5, "[1, 2, 3]").otherwise("[1, 2, 30, 40]"), F.lit("}"))
    regions = F.when(F.col("event_id") % 30 > 0, F.array_join(F.transform(F.sequence(F.lit(0), (F.col("event_id") % 30 - 1).cast("int")), region), ", ")).otherwise("")
    body = F.concat(F.lit('Here it is: {"columns_are": "'), F.expr(_CLASS), F.lit('", "regions": ['), regions, F.lit("]} Done."))
    return first.select("user_id", "event_id", body.alias("reply"))


@query(f"""WITH {_RUNS}, capped AS (SELECT user_id, event_id, cls, least(regions, 20) AS regions FROM runs), won AS (SELECT user_id, cls FROM (SELECT user_id, cls, count(*) AS n, min(event_id) AS first FROM capped GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first) = 1),
mid AS (SELECT user_id, cls, list(regions ORDER BY regions, event_id) AS l FROM capped JOIN won USING (user_id, cls) GROUP BY ALL)
SELECT user_id, cls, l[len(l) // 2 + 1]::INT AS regions, cls = 'independent_prose' AND l[len(l) // 2 + 1] > 1 AS crops FROM mid""")
def layout_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class most of a page's layout replies give, and of those the reply with the middle number of regions."""
    r = _runs(spark, sf_dir).select("user_id", "event_id", L.reply(F.col("reply")).alias("r")).select("user_id", "event_id", "r.columns_are", F.size("r.regions").alias("n"))
    v = G.middle_of_majority(r, "user_id", "columns_are", "n", "event_id")
    return v.select("user_id", F.col("columns_are").alias("cls"), F.col("n").alias("regions"), L.routes_to_crops(F.col("columns_are"), F.col("n")).alias("crops"))


_INK = "inked AS (SELECT doc_id, contains(trim(text), '[BLANK PAGE]') OR length(trim(text)) < 40 AS blank, ((doc_id * 7919) % 1000) / 1000.0 + CASE WHEN length(trim(text)) < 40 THEN 0 ELSE 0.3 END AS ink FROM documents)"


def _inked(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    short = F.length(F.trim(F.coalesce("text", F.lit("")))) < 40
    return d.select("doc_id", L.is_blank(F.col("text")).alias("blank"), ((F.col("doc_id") * 7919) % 1000 / 1000 + F.when(short, 0.0).otherwise(0.3)).alias("ink"))


@query(f"WITH {_INK} SELECT blank, count(*) AS n, round(median(ink), 6) AS median, round(min(ink), 6) AS least, round(max(ink), 6) AS most FROM inked GROUP BY blank")
def ink_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _inked(spark, sf_dir).groupBy("blank").agg(F.count(F.lit(1)).alias("n"), *[F.round(f("ink"), 6).alias(a) for f, a in ((F.median, "median"), (F.min, "least"), (F.max, "most"))])


@query(f"""WITH {_INK}, k AS (SELECT min(ink) FILTER (NOT blank) AS safe FROM inked), t AS (SELECT DISTINCT round(ink, 5) AS t FROM inked, k WHERE round(ink, 5) < safe),
r AS (SELECT t, (SELECT count(*) FROM inked WHERE blank AND ink < t) AS found FROM t)
SELECT coalesce(round(arg_max(t, (found, -t)), 5), 0.0) AS threshold, coalesce(max(found), 0) AS found, (SELECT count(*) FROM inked WHERE blank) AS blanks FROM r WHERE found > 0""")
def blank_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest threshold that finds the most blank pages without losing a page of text."""
    return G.safe_threshold(_inked(spark, sf_dir), "blank", "ink").withColumn("threshold", F.round("threshold", 5))


@query("SELECT doc_id, count(*) OVER () AS kept FROM documents WHERE text NOT IN ('[BLANK PAGE]', '[PLATE]') AND trim(text) <> '' AND length(text) >= 60")
def text_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that are neither blank nor plates and have 60 characters; their number beside each."""
    d = table(spark, sf_dir, "documents").where(~F.col("text").isin("[BLANK PAGE]", "[PLATE]") & (F.trim("text") != "") & (F.length("text") >= 60)).select("doc_id")
    return d.crossJoin(F.broadcast(d.agg(F.count(F.lit(1)).alias("kept"))))


@query("SELECT source AS book, count(*) AS n, md5(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id)) AS pages FROM documents WHERE length(trim(text)) < 40 GROUP BY source")
def fallback_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank readings to be made again, by book."""
    d = table(spark, sf_dir, "documents").where(F.length(F.trim(F.coalesce("text", F.lit("")))) < 40)
    pages = F.array_join(F.array_sort(F.collect_list("doc_id")).cast("array<string>"), ",")
    return d.groupBy(F.col("source").alias("book")).agg(F.count(F.lit(1)).alias("n"), F.md5(pages.cast("binary")).alias("pages"))


_PRICES = {"large": (2.0, 12.0), "middle": (1.25, 10.0), "small": (0.25, 1.5)}
_PRICED = "(VALUES " + ", ".join(f"('{m}', {i}, {o})" for m, (i, o) in _PRICES.items()) + ") prices(model, pin, pout)"
_CALLS = f"""calls AS (SELECT event_id, user_id, model, CASE WHEN event_id % 13 = 0 THEN 'status ' || (400 + event_id % 5) END AS error, CASE WHEN event_id % 13 <> 0 THEN value / 200 END AS cer, CASE WHEN event_id % 13 <> 0 THEN 1 - value / 200 END AS yield,
((event_id % 700) * pin + greatest(event_id % 900, event_id % 2000 - event_id % 700) * pout) / 1e6 AS usd FROM (SELECT *, CASE event_id % 3 WHEN 0 THEN 'large' WHEN 1 THEN 'middle' ELSE 'small' END AS model FROM events WHERE value IS NOT NULL) JOIN {_PRICED} USING (model))"""


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    prices = spark.createDataFrame([(m, *p) for m, p in _PRICES.items()], "model string, pin double, pout double")
    e = table(spark, sf_dir, "events").where("value IS NOT NULL").withColumn("model", F.when(i % 3 == 0, "large").when(i % 3 == 1, "middle").otherwise("small")).join(F.broadcast(prices), "model")
    ok = i % 13 != 0
    out = M.output_tokens(i % 900, F.lit(0), i % 2000, i % 700)
    return e.select("event_id", "user_id", "model", F.when(~ok, F.concat(F.lit("status "), (400 + i % 5).cast("string"))).alias("error"), F.when(ok, F.col("value") / 200).alias("cer"), F.when(ok, 1 - F.col("value") / 200).alias("yield"), M.usd(i % 700, out, F.col("pin"), F.col("pout")).alias("usd"))


@query(f"""WITH {_CALLS} SELECT model, count(*) AS calls, count(cer) AS scored, count(error) AS errors, arg_min(error, event_id) FILTER (error IS NOT NULL) AS sample_error, round(median(cer), 6) AS cer_median, round(avg(yield), 6) AS yield_mean,
round(sum(usd) / count(*), 9) AS usd_page, round(sum(usd) / count(*) * 63000, 4) AS usd_all, round(sum(usd) / count(*) / avg(yield), 9) AS usd_yield FROM calls GROUP BY model""")
def arm_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls, errors with the first as a sample, medians and what a page, the collection and a unit of yield cost."""
    c = _calls(spark, sf_dir)
    a = c.groupBy("model").agg(F.count(F.lit(1)).alias("calls"), F.count("cer").alias("scored"), F.count("error").alias("errors"), F.min_by("error", F.when(F.col("error").isNotNull(), F.col("event_id"))).alias("sample_error"), F.round(F.median("cer"), 6).alias("cer_median"), F.avg("yield").alias("y"), (F.sum("usd") / F.count(F.lit(1))).alias("u"))
    return a.select("model", "calls", "scored", "errors", "sample_error", "cer_median", F.round("y", 6).alias("yield_mean"), F.round("u", 9).alias("usd_page"), F.round(F.col("u") * 63000, 4).alias("usd_all"), F.round(F.col("u") / F.col("y"), 9).alias("usd_yield"))


@query("SELECT source AS book, round(count(*) * (1271 * 1.0 + 1216 * 6.0) / 1e6, 6) AS usd FROM documents GROUP BY source")
def batch_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What reading each book would cost, by the tokens of a usual page."""
    return table(spark, sf_dir, "documents").groupBy(F.col("source").alias("book")).agg(F.round(F.count(F.lit(1)) * (1271 * 1.0 + 1216 * 6.0) / 1e6, 6).alias("usd"))


@query("SELECT sum(p_size)::BIGINT AS bytes, count(*) FILTER (p_size < 3) AS missing, round(sum(p_size) / 7.0)::BIGINT AS pages FROM part")
def catalogue_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes, missing volumes and pages by the bytes of a usual one."""
    return table(spark, sf_dir, "part").agg(F.sum("p_size").alias("bytes"), F.count_if(F.col("p_size") < 3).alias("missing"), F.round(F.sum("p_size") / 7.0).cast("long").alias("pages"))


@query(r"""WITH b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '') AS w FROM benchmark), t AS (SELECT item_id, len(w) AS n, len(list_filter(w, lambda x, i: i % 9 = 5)) AS lost FROM b)
SELECT sum(n)::BIGINT AS correct_tokens_total, sum(lost)::BIGINT AS false_corr_total, round(sum(lost) / sum(n), 6) AS rate FROM t""")
def damage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What corrections that spoil one word in nine do to right tokens, over all pages: a ratio of sums."""
    t = F.array_join(F.filter(F.split(F.lower("text"), r"\s+"), lambda w: F.length(w) > 0), " ")
    b = table(spark, sf_dir, "benchmark").select(t.alias("t"))
    worse = F.array_join(F.transform(F.split("t", " "), lambda w, i: F.when(i % 9 == 4, F.lit("~")).otherwise(w)), " ")
    d = b.select(M.damage(F.col("t"), worse, F.col("t")).alias("d")).agg(F.sum("d.correct_tokens").alias("correct_tokens_total"), F.sum("d.false_corr").alias("false_corr_total"))
    return d.withColumn("rate", F.round(F.col("false_corr_total") / F.col("correct_tokens_total"), 6))


@query("""SELECT event_id, (1000 + event_id % 4000) AS w, CASE WHEN greatest(1000 + event_id % 4000, 2000) > 3500 THEN floor((1000 + event_id % 4000) * (3500.0 / greatest(1000 + event_id % 4000, 2000)))::INT ELSE (1000 + event_id % 4000)::INT END AS width,
'https://images/v' || user_id || '/' || lpad((event_id % 900)::VARCHAR, 5, '0') || '.jpg' AS image, CASE WHEN event_id % 6 IN (1, 3, 5) THEN 3 * (event_id % 4 + 1) END::INT AS wait FROM events""")
def page_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scaled widths, image names and waits between attempts."""
    i = F.col("event_id")
    w = 1000 + i % 4000
    status = F.element_at(F.array(*[F.lit(x) for x in (200, 429, 400, 503, 404, 401)]), (i % 6 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", w.alias("w"), L.scaled(w, F.lit(2000), 3500)["width"].alias("width"), L.page_image("https://images/", F.concat(F.lit("v"), F.col("user_id").cast("string")), i % 900).alias("image"), L.backoff(i % 4, status).cast("int").alias("wait"))


@query("SELECT doc_id, arg_max(event_id, event_id) AS last_event FROM (SELECT event_id % (SELECT count(*) FROM documents) AS doc_id, event_id FROM events) JOIN documents USING (doc_id) GROUP BY doc_id")
def last_wins_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold rows with the last alignment of their page: later rows of a key take the place of earlier ones."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    n = d.agg(F.count(F.lit(1)).alias("n"))
    e = table(spark, sf_dir, "events").crossJoin(F.broadcast(n)).groupBy((F.col("event_id") % F.col("n")).alias("doc_id")).agg(F.max("event_id").alias("last_event"))
    return d.join(e, "doc_id")


#: Readings of pages whose last ones hit the token limit, and second readings of some of those with a higher one.
_READ = "SELECT doc_id AS page, CASE WHEN n_chars > 4000 THEN 'MAX_TOKENS' ELSE 'STOP' END AS finish, left(text, 4000) AS text FROM documents"
_AGAIN = "SELECT doc_id AS page, CASE WHEN n_chars > 12000 THEN 'MAX_TOKENS' ELSE 'STOP' END AS finish, left(text, 12000) AS text FROM documents WHERE n_chars > 4000 AND doc_id % 3 > 0"


def _readings(spark, sf_dir, most, where):
    d = table(spark, sf_dir, "documents").where(where)
    return d.select(F.col("doc_id").alias("page"), F.when(F.col("n_chars") > most, "MAX_TOKENS").otherwise("STOP").alias("finish"), F.left("text", F.lit(most)).alias("text"))


@query(f"SELECT DISTINCT page FROM ({_READ}) WHERE finish = 'MAX_TOKENS'")
def truncated_pages(spark, sf_dir):
    """The pages to read again: whose reading ended at the limit."""
    return G.to_reread(_readings(spark, sf_dir, 4000, "true"))


@query(f"SELECT page, coalesce(a.finish, r.finish) AS finish, md5(coalesce(a.text, r.text)) AS text FROM ({_READ}) r LEFT JOIN ({_AGAIN}) a USING (page)")
def truncated_fixed(spark, sf_dir):
    """All readings with second ones in their place; a page that wasn't read again keeps its first."""
    again = _readings(spark, sf_dir, 12000, "n_chars > 4000 AND doc_id % 3 > 0")
    return G.reread(_readings(spark, sf_dir, 4000, "true"), again).select("page", "finish", F.md5(F.col("text").cast("binary")).alias("text"))


#: Readings of which some repeat a line and some end at a mark, and one in eleven failed.
_MARKED = """(SELECT key, reader, CASE WHEN reader = 'b' AND key % 3 = 0 THEN repeat(t || chr(10), 5) WHEN reader = 'c' AND key % 4 = 1 THEN t || ' [TRUNCATED]' ELSE t END AS t, key % 11 = 0 AS failed FROM reads)"""


@query(f"""WITH {_READS}, m AS {_MARKED}, g AS (SELECT key, t AS ref FROM reads WHERE reader = 'a'),
w AS (SELECT reader, t, list_filter(regexp_split_to_array(t, '\\s+'), lambda w: w <> '') AS x, list_filter(regexp_split_to_array(ref, '\\s+'), lambda w: w <> '') AS y FROM m JOIN g USING (key) WHERE NOT failed),
k AS (SELECT *, list_distinct(list_concat(x, y)) AS kinds, list_filter(list_transform(string_split(t, chr(10)), lambda l: trim(l)), lambda l: length(l) >= 6) AS l FROM w),
s AS (SELECT reader, t, CASE WHEN len(y) > 0 THEN levenshtein(array_to_string(list_transform(x, lambda w: chr(list_position(kinds, w)::INT)), ''), array_to_string(list_transform(y, lambda w: chr(list_position(kinds, w)::INT)), '')) / len(y) END AS wer, len(l) >= 4 AND (coalesce(list_max(map_values(list_histogram(l))), 0) >= 4 OR (len(l) - len(list_distinct(l))) / len(l) > 0.30) AS degenerate FROM k)
SELECT reader, count(*) AS n, round(avg(wer), 6) AS wer_mean, count(*) FILTER (degenerate) AS degenerate, count(*) FILTER (contains(t, '[TRUNCATED')) AS truncated FROM s GROUP BY reader""")
def bench_counts(spark, sf_dir):
    """Word errors, and how many readings repeat themselves or break off, by reader."""
    r = _reads(spark, sf_dir)
    t = F.when((F.col("reader") == "b") & (F.col("key") % 3 == 0), F.repeat(F.concat("t", F.lit("\n")), F.lit(5))).when((F.col("reader") == "c") & (F.col("key") % 4 == 1), F.concat("t", F.lit(" [TRUNCATED]"))).otherwise(F.col("t"))
    ref = r.where("reader = 'a'").select("key", F.col("t").alias("ref"))
    rows = r.select("key", "reader", t.alias("t"), (F.col("key") % 11 == 0).alias("failed")).join(ref, "key")
    return G.bench_counts(rows, "reader", "t", "ref", "failed").withColumn("wer_mean", F.round("wer_mean", 6))
