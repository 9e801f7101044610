"""Alignment with reference passages, HTML records, exports, harvesting lists, fixity and event windows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import metrics as M
from quire.functions import text as T
from quire.operators.align import alignment, anchor_votes, multiset_overlap, with_text
from quire.operators.index import shared_root
from quire.operators.search import spread
from quire.plans.corpus_queries import fold_sql, in_bytes
from quire.plans.registry import query
from quire.streaming.limits import allowed_hits
from quire.tables import corpus, table

_TOKENS = f"""edition AS (SELECT item_id, tok, (row_number() OVER (ORDER BY item_id, i) - 1) AS pos FROM (SELECT item_id, unnest(w) AS tok, generate_subscripts(w, 1) AS i FROM (SELECT item_id, list_filter(string_split({fold_sql('text')}, ' '), lambda x: x <> '') AS w FROM benchmark))),
rare AS (SELECT tok FROM edition GROUP BY tok HAVING count(*) <= 25 AND length(tok) >= 3),
page AS (SELECT doc_id, tok, i - 1 AS pos FROM (SELECT doc_id, unnest(w) AS tok, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, list_filter(string_split({fold_sql('text')}, ' '), lambda x: x <> '') AS w FROM documents)))"""


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edition as one stream of (tok, pos): positions from prefix sums over passages' sizes alone."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.filter(F.split(T.fold_search(F.col("text"), False, True), " "), lambda x: F.length(x) > 0).alias("w"))
    base = b.select("item_id", F.size("w").alias("n")).select("item_id", F.coalesce(F.sum("n").over(Window.orderBy("item_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return b.join(base, "item_id").select("base", F.posexplode("w").alias("i", "tok")).select("tok", (F.col("base") + F.col("i")).alias("pos"))


def _page_tokens(spark: SparkSession, sf_dir: str, kept: bool = False) -> DataFrame:
    """Pages' tokens and places. Texts are folded once: in one pass, or, for many passes, kept in files first."""
    w = F.filter(F.split(T.fold_search(F.col("text"), False, True), " "), lambda x: F.length(x) > 0)
    # A generator of one row: Catalyst would otherwise fold again to see whether there is anything to explode.
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.explode(F.array(w)).alias("w"))
    if kept:
        path = f"{shared_root(spark)}/tokens/{uuid.uuid4().hex}"
        d.write.parquet(path)
        d = spark.read.parquet(path)
    return d.select("doc_id", F.posexplode("w").alias("pos", "tok"))


@query(f"""WITH {_TOKENS}, hits AS (SELECT p.doc_id, p.tok, p.pos, e.pos - p.pos AS off FROM page p JOIN rare USING (tok) JOIN edition e USING (tok)),
v AS (SELECT doc_id, floor(off / 32)::BIGINT AS bucket, count(*) AS votes, min((pos, off)) AS first FROM hits GROUP BY doc_id, bucket), n AS (SELECT doc_id, count(DISTINCT pos) AS anchors FROM hits GROUP BY doc_id)
SELECT doc_id, bucket, votes, round(votes / anchors, 6) AS vote_ratio FROM v JOIN n USING (doc_id) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY votes DESC, first) = 1""")
def align_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anchor_votes(_page_tokens(spark, sf_dir), _stream(spark, sf_dir), "doc_id").withColumn("vote_ratio", F.round("vote_ratio", 6))


@query(f"""WITH {_TOKENS}, a AS (SELECT doc_id, tok, count(*) AS n FROM page GROUP BY ALL), b AS (SELECT tok, count(*) AS n FROM edition GROUP BY tok)
SELECT doc_id, sum(coalesce(least(a.n, b.n), 0) * (b.n IS NOT NULL)::INT)::BIGINT AS shared, round(sum(coalesce(least(a.n, b.n), 0) * (b.n IS NOT NULL)::INT) / sum(a.n), 6) AS share FROM a LEFT JOIN b USING (tok) GROUP BY doc_id""")
def token_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset_overlap(_page_tokens(spark, sf_dir), _stream(spark, sf_dir), "doc_id").withColumn("share", F.round("share", 6))


_ALIGNED = f"""{_TOKENS}, hits AS (SELECT p.doc_id, p.tok, p.pos, e.pos AS loc, floor((e.pos - p.pos) / 32)::BIGINT AS bucket FROM page p JOIN rare USING (tok) JOIN edition e USING (tok)),
sizes AS (SELECT doc_id, count(*) AS tokens FROM page GROUP BY 1 HAVING count(*) >= 40), n AS (SELECT doc_id, count(DISTINCT pos) AS anchored FROM hits GROUP BY 1 HAVING count(DISTINCT pos) >= 12),
won AS (SELECT doc_id, bucket, votes FROM (SELECT doc_id, bucket, count(*) AS votes, min((pos, loc)) AS first FROM hits GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY votes DESC, first) = 1),
inside AS (SELECT h.* FROM hits h JOIN won USING (doc_id, bucket)),
start AS (SELECT doc_id, greatest(0, off) AS start FROM (SELECT doc_id, loc - pos AS off, count(*) AS k, min((pos, loc)) AS first FROM inside GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY k DESC, first) = 1),
place AS (SELECT doc_id, pos, tok, min(loc) AS loc FROM inside GROUP BY ALL),
shape AS (SELECT doc_id, count(DISTINCT tok) AS types, max(pos) - min(pos) AS reach, list(loc ORDER BY pos) AS places FROM place GROUP BY 1),
found AS (SELECT * FROM won JOIN sizes USING (doc_id) JOIN n USING (doc_id) JOIN start USING (doc_id) JOIN shape USING (doc_id) WHERE start <= (SELECT max(pos) FROM edition)),
stop AS (SELECT tok FROM (SELECT tok, count(*) AS k, min(pos) AS first FROM edition GROUP BY 1 ORDER BY k DESC, first LIMIT 150)),
own AS (SELECT doc_id, tok, count(*) AS n FROM page WHERE doc_id IN (SELECT doc_id FROM found) AND tok NOT IN (SELECT tok FROM stop) GROUP BY ALL),
win AS (SELECT doc_id, tok, count(*) AS m FROM found JOIN edition ON edition.pos BETWEEN start AND start + tokens - 1 WHERE tok NOT IN (SELECT tok FROM stop) GROUP BY ALL),
jac AS (SELECT doc_id, coalesce(sum(least(n, m)) FILTER (n IS NOT NULL AND m IS NOT NULL), 0) / greatest(1, sum(coalesce(n, 0)), sum(coalesce(m, 0))) AS jaccard FROM own FULL JOIN win USING (doc_id, tok) GROUP BY 1)"""
_LIS = """tails AS (SELECT doc_id, places, 1 AS k, [places[1]] AS t FROM found UNION ALL
SELECT doc_id, places, k + 1, list_filter(t, lambda x: x < places[k + 1]) || [places[k + 1]] || list_slice(t, len(list_filter(t, lambda x: x < places[k + 1])) + 2, len(t)) FROM tails WHERE k < len(places)),
lis AS (SELECT doc_id, len(t) AS lis FROM tails WHERE k = len(places))"""
_RECORD = f"""WITH RECURSIVE {_ALIGNED}, {_LIS}, record AS (SELECT doc_id, tokens, anchored, votes, votes / anchored AS vote_ratio, start, types, reach / tokens AS span, lis::INT AS lis, len(places)::INT AS placed, coalesce(jaccard, 0) AS jaccard
FROM found JOIN lis USING (doc_id) LEFT JOIN jac USING (doc_id)),
tiered AS (SELECT *, CASE WHEN vote_ratio >= 0.20 AND jaccard >= 0.15 AND types >= 12 THEN 'gold' WHEN vote_ratio >= 0.12 AND jaccard >= 0.10 THEN 'review' ELSE 'reject' END AS tier FROM record)"""


def _aligned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    pages, stream = _page_tokens(spark, sf_dir, kept=True), _stream(spark, sf_dir)
    return alignment(pages, stream, "doc_id"), pages, stream


@query(f"{_RECORD} SELECT doc_id, lis FROM record")
def lis_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aligned(spark, sf_dir)[0].select("doc_id", "lis")


@query(f"{_RECORD} SELECT doc_id, tokens, anchored, votes, round(vote_ratio, 6) AS vote_ratio, start, types, round(span, 6) AS span, lis, placed, round(jaccard, 6) AS jaccard, tier FROM tiered")
def align_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole record of every page against the edition."""
    r = _aligned(spark, sf_dir)[0]
    return r.withColumns({c: F.round(c, 6) for c in ("vote_ratio", "span", "jaccard")})


@query(f"""{_RECORD}, texts AS (SELECT doc_id, string_agg(tok, ' ' ORDER BY pos) AS a FROM page WHERE doc_id IN (SELECT doc_id FROM tiered WHERE tier <> 'reject') GROUP BY 1),
editions AS (SELECT doc_id, string_agg(tok, ' ' ORDER BY pos) AS b FROM tiered JOIN edition ON pos BETWEEN start AND start + tokens - 1 WHERE tier <> 'reject' GROUP BY 1)
SELECT doc_id, tier, md5(a) AS page, md5(b) AS edition, round(levenshtein({in_bytes('a', 'kinds')}, {in_bytes('b', 'kinds')}) / greatest(length(a), length(b)), 6) AS cer FROM (SELECT *, list_distinct(string_split(a || b, '')) AS kinds FROM tiered JOIN texts USING (doc_id) JOIN editions USING (doc_id))""")
def align_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs for the judge, with their distance."""
    records, pages, stream = _aligned(spark, sf_dir)
    d = with_text(records, pages, stream, "doc_id")
    return d.select("doc_id", "tier", F.md5(F.col("page_text").cast("binary")).alias("page"), F.md5(F.col("edition_text").cast("binary")).alias("edition"), F.round("cer", 6).alias("cer"))


_NOISY = "SELECT tok, pos, pos // 300 AS doc_id, pos % 300 AS i FROM edition WHERE pos < 300 * (SELECT (max(pos) + 1) // 300 FROM edition)"


@query(f"""{_RECORD.replace('page AS (', f"clean AS ({_NOISY}), page AS (SELECT doc_id, CASE WHEN (i * 7 + doc_id) % 10 < 3 AND length(tok) > 1 THEN left(tok, length(tok) - 1) ELSE tok END AS tok, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos FROM clean WHERE (i * 13 + doc_id) % 10 >= 3), old_page AS (", 1)}
SELECT doc_id, start, round(vote_ratio, 6) AS vote_ratio, tier FROM tiered""")
def align_selftest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of 300 tokens of the edition itself with three in ten lost and three in ten clipped: the gates must find them."""
    stream = _stream(spark, sf_dir)
    whole = stream.agg(F.floor((F.max("pos") + 1) / 300).alias("runs"))
    d, i = F.floor(F.col("pos") / 300), F.col("pos") % 300
    cut = stream.crossJoin(F.broadcast(whole)).where(F.col("pos") < 300 * F.col("runs")).select(d.alias("doc_id"), i.alias("i"), "tok").where((F.col("i") * 13 + F.col("doc_id")) % 10 >= 3)
    clip = F.when(((F.col("i") * 7 + F.col("doc_id")) % 10 < 3) & (F.length("tok") > 1), F.expr("left(tok, length(tok) - 1)")).otherwise(F.col("tok"))
    pages = cut.select("doc_id", clip.alias("tok"), (F.row_number().over(Window.partitionBy("doc_id").orderBy("i")) - 1).alias("pos"))
    return alignment(pages, stream, "doc_id").select("doc_id", "start", F.round("vote_ratio", 6).alias("vote_ratio"), "tier")


def _blocks_sql(pairs: str) -> str:
    """CTEs over pairs(item_id, kind, a, b), lists of tokens: best has the matching blocks (i, j, n), each the longest of its range; q the ranges."""
    clipped = """SELECT * FROM (SELECT q.*, greatest(s, lo, le - d) AS i, greatest(s, lo, le - d) + d AS j, least(e, hi, ri - d) - greatest(s, lo, le - d) AS n, row_number() OVER (PARTITION BY item_id, kind, lo, hi, le, ri ORDER BY least(e, hi, ri - d) - greatest(s, lo, le - d) DESC, greatest(s, lo, le - d), d) AS nth
FROM q JOIN r USING (item_id, kind) WHERE least(e, hi, ri - d) > greatest(s, lo, le - d)) WHERE nth = 1"""
    return f"""pairs AS ({pairs}),
m AS (SELECT item_id, kind, i, j, j - i AS d FROM (SELECT item_id, kind, unnest(a) AS tok, generate_subscripts(a, 1) - 1 AS i FROM pairs) JOIN (SELECT item_id, kind, unnest(b) AS tok, generate_subscripts(b, 1) - 1 AS j FROM pairs) USING (item_id, kind, tok)),
r AS (SELECT item_id, kind, d, min(i) AS s, max(i) + 1 AS e FROM (SELECT *, i - row_number() OVER (PARTITION BY item_id, kind, d ORDER BY i) AS g FROM m) GROUP BY item_id, kind, d, g),
q AS (SELECT item_id, kind, 0::BIGINT AS lo, len(a) AS hi, 0::BIGINT AS le, len(b) AS ri FROM pairs UNION ALL
SELECT item_id, kind, CASE WHEN side = 0 THEN lo ELSE i + n END, CASE WHEN side = 0 THEN i ELSE hi END, CASE WHEN side = 0 THEN le ELSE j + n END, CASE WHEN side = 0 THEN j ELSE ri END FROM ({clipped}), (VALUES (0), (1)) sides(side)
WHERE CASE WHEN side = 0 THEN i > lo AND j > le ELSE i + n < hi AND j + n < ri END),
best AS ({clipped}),
spans AS (SELECT item_id, kind, min(i) AS a0, max(i + n) AS a1, min(j) AS b0, max(j + n) AS b1 FROM best WHERE n >= 2 GROUP BY item_id, kind)"""


_WORDS = "list_filter(string_split({}, ' '), lambda w: w <> '')"
_WORSE = "array_to_string(list_filter(string_split(t, ' '), lambda w, i: (i - 1) % 9 <> 4), ' ')"
_SPANNED = f"""WITH RECURSIVE t AS (SELECT item_id, repeat({fold_sql('text')} || ' ', 4) AS t FROM benchmark),
{_blocks_sql(f"SELECT item_id, 0 AS kind, {_WORDS.format(_WORSE)} AS a, {_WORDS.format('t')} AS b FROM t")},
cut AS (SELECT item_id, a, b, a[a0 + 1:a1] AS x, b[b0 + 1:b1] AS y FROM pairs JOIN spans USING (item_id, kind) WHERE least(a1 - a0, b1 - b0) >= 60),
k AS (SELECT *, list_distinct(list_concat(x, y)) AS kinds FROM cut),
c AS (SELECT item_id, len(a) AS na, len(b) AS nb, len(x) AS nx, len(y) AS ny, levenshtein(array_to_string(list_transform(x, lambda w: chr(list_position(kinds, w)::INT)), ''), array_to_string(list_transform(y, lambda w: chr(list_position(kinds, w)::INT)), '')) AS e FROM k)
SELECT item_id, e / greatest(nx, ny) AS cer, ny / nb AS ref_recall, ny / nb * (1 - e / greatest(nx, ny)) AS yield, nx / na AS span_coverage, nx AS span_tokens FROM t LEFT JOIN c USING (item_id)"""


@query(_SPANNED)
def span_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages, four times over, against the same with one word in nine gone."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.repeat(F.concat(T.fold_search(F.col("text"), False, True), F.lit(" ")), F.lit(4)).alias("t"))
    worse = F.array_join(F.filter(F.split("t", " "), lambda w, i: i % 9 != 4), " ")
    return b.select("item_id", M.span_score(worse, F.col("t")).alias("s")).select("item_id", "s.*")


_RE, _HT = "replace(t, 'er ', 're ')", "replace(t, 'th', 'ht')"
_EDITED = f"""WITH RECURSIVE t AS (SELECT item_id, {fold_sql('text')} AS t FROM benchmark),
{_blocks_sql(f"SELECT item_id, 0 AS kind, {_WORDS.format('t')} AS a, {_WORDS.format(_RE)} AS b FROM t UNION ALL SELECT item_id, 1, {_WORDS.format('t')}, {_WORDS.format(_HT)} FROM t")},
hits AS (SELECT DISTINCT item_id, kind, i + unnest(range(n)) AS i FROM best),
inside AS (SELECT item_id, unnest(range(a0, a1)) AS i FROM spans WHERE kind = 0),
marked AS (SELECT item_id, i, (item_id, i) IN (SELECT (item_id, i) FROM hits WHERE kind = 0) AS good, (item_id, i) IN (SELECT (item_id, i) FROM hits WHERE kind = 1) AS kept FROM inside),
d AS (SELECT item_id, count(*) FILTER (good) AS correct_tokens, count(*) FILTER (good AND NOT kept) AS false_corr, count(*) FILTER (NOT good) AS wrong, count(*) FILTER (NOT good AND NOT kept) AS touched FROM marked GROUP BY item_id)
SELECT item_id, correct_tokens, false_corr, false_corr / correct_tokens AS false_corr_rate, CASE WHEN wrong > 0 THEN touched / wrong END AS touched_wrong_rate FROM t LEFT JOIN (SELECT * FROM d WHERE correct_tokens > 0) USING (item_id)"""


@query(_EDITED)
def damage(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").select("item_id", T.fold_search(F.col("text"), False, True).alias("t"))
    return b.select("item_id", M.damage(F.col("t"), F.regexp_replace("t", "th", "ht"), F.regexp_replace("t", "er ", "re ")).alias("s")).select("item_id", "s.*")


@query("SELECT doc_id, replace(replace(text, 'the', 'teh'), 'and', 'nad') AS text, (contains(text, 'the')::INT + contains(replace(text, 'the', 'teh'), 'and')::INT) AS applied FROM documents")
def apply_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    edits = '```json\n[{"old": "the", "new": "teh"}, {"old": "and", "new": "nad"}, {"old": "x", "new": "x"}, 5]\n```'
    return table(spark, sf_dir, "documents").select("doc_id", M.apply_edits(F.col("text"), F.lit(edits)).alias("s")).select("doc_id", "s.*")


@query(r"""SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) AS body, length(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)) AS title FROM pages""")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace("html", r"(?s)<(script|style)[^>]*>.*?</(script|style)>", " "), "<[^>]*>", " "), r"\s+", " ")
    return table(spark, sf_dir, "pages").select("page_id", F.md5(F.trim(t).cast("binary")).alias("body"), F.length(F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)).alias("title"))


@query("""SELECT DISTINCT link FROM (SELECT unnest(regexp_extract_all(html, 'href="(/[^"]+)"', 1)) AS link FROM pages) ORDER BY 1""")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.explode(F.regexp_extract_all("html", F.lit('href="(/[^"]+)"'), 1)).alias("link")).distinct().orderBy("link")


_ESC = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_FULL = "list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '')"


def _numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select("page", T.full_lines(F.col("raw")).alias("l"))


@query(f"""SELECT doc_id AS page, md5('<Page ID="P' || doc_id || '">' || array_to_string(list_transform({_FULL}, lambda x, i: '<TextLine ID="P' || doc_id || '_L' || i || '"><String ID="P' || doc_id || '_L' || i || '_S1" CONTENT="' || replace({_ESC.format('x')}, '"', '&quot;') || '"/></TextLine>'), '') || '</Page>') AS alto FROM documents""")
def export_alto(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("page").cast("string")
    line = lambda x, i: F.concat(F.lit('<TextLine ID="P'), p, F.lit("_L"), (i + 1).cast("string"), F.lit('"><String ID="P'), p, F.lit("_L"), (i + 1).cast("string"), F.lit('_S1" CONTENT="'), T.xml_escape(x, True), F.lit('"/></TextLine>'))
    return _numbered_lines(spark, sf_dir).select("page", F.md5(F.concat(F.lit('<Page ID="P'), p, F.lit('">'), F.array_join(F.transform("l", line), ""), F.lit("</Page>")).cast("binary")).alias("alto"))


@query(f"""SELECT doc_id AS page, md5('<div class="ocr_page" id="page_' || doc_id || '">' || array_to_string(list_transform({_FULL}, lambda x, i: '<span class="ocr_line" id="line_' || doc_id || '_' || i || '">' || {_ESC.format('x')} || '</span>'), chr(10)) || '</div>') AS hocr FROM documents""")
def export_hocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("page").cast("string")
    line = lambda x, i: F.concat(F.lit('<span class="ocr_line" id="line_'), p, F.lit("_"), (i + 1).cast("string"), F.lit('">'), T.xml_escape(x), F.lit("</span>"))
    return _numbered_lines(spark, sf_dir).select("page", F.md5(F.concat(F.lit('<div class="ocr_page" id="page_'), p, F.lit('">'), F.array_join(F.transform("l", line), "\n"), F.lit("</div>")).cast("binary")).alias("hocr"))


@query(f"""SELECT doc_id AS page, md5('<pb n="' || doc_id || '"/>' || array_to_string(list_transform({_FULL}, lambda x: '<l>' || {_ESC.format('x')} || '</l>'), chr(10))) AS tei FROM documents""")
def export_tei(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("page").cast("string")
    line = lambda x: F.concat(F.lit("<l>"), T.xml_escape(x), F.lit("</l>"))
    return _numbered_lines(spark, sf_dir).select("page", F.md5(F.concat(F.lit('<pb n="'), p, F.lit('"/>'), F.array_join(F.transform("l", line), "\n")).cast("binary")).alias("tei"))


@query("SELECT doc_id AS page, md5(chr(10) || '--- page ' || doc_id || ' ---' || chr(10) || text) AS body FROM documents")
def export_txt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select("page", F.md5(F.concat(F.lit("\n--- page "), F.col("page").cast("string"), F.lit(" ---\n"), F.coalesce("raw", F.lit(""))).cast("binary")).alias("body"))


@query("""SELECT '<header><identifier>oai:quire:' || source || '</identifier><datestamp>2024-01-01</datestamp></header>' AS header, row_number() OVER (ORDER BY source) - 1 AS cursor FROM (SELECT DISTINCT source FROM documents) QUALIFY cursor < 100""")
def oai_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page of a harvest list: books in order, at most 100; books are few, so one window ranks them."""
    books = corpus(spark, sf_dir).select("book").distinct()
    ranked = books.withColumn("cursor", F.row_number().over(Window.orderBy("book")) - 1).where("cursor < 100")
    return ranked.select(F.concat(F.lit("<header><identifier>oai:quire:"), "book", F.lit("</identifier><datestamp>2024-01-01</datestamp></header>")).alias("header"), "cursor")


@query("SELECT (row_number() OVER (ORDER BY source, doc_id) - 1) // 300 AS chunk, doc_id FROM documents")
def sitemap_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks over the order (book, page): ranks within a book by a window, books' bases by prefix sums."""
    c = corpus(spark, sf_dir).select("book", "page")
    n = c.groupBy("book").agg(F.count(F.lit(1)).alias("n"))
    base = n.select("book", F.coalesce(F.sum("n").over(Window.orderBy("book").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    r = c.withColumn("i", F.row_number().over(Window.partitionBy("book").orderBy("page")) - 1).join(base, "book")
    return r.select(F.floor((F.col("base") + F.col("i")) / 300).alias("chunk"), F.col("page").alias("doc_id"))


@query("SELECT sha256(text) || '  data/' || source || '/' || doc_id || '.txt' AS line FROM documents")
def bag_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select(F.concat(F.sha2(F.col("raw").cast("binary"), 256), F.lit("  data/"), "book", F.lit("/"), F.col("page").cast("string"), F.lit(".txt")).alias("line"))


@query("SELECT sum(strlen(text))::BIGINT || '.' || count(*) AS oxum FROM documents")
def payload_oxum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).agg(F.concat_ws(".", F.sum(F.octet_length("raw")).cast("string"), F.count(F.lit(1)).cast("string")).alias("oxum"))


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", "total")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS began, count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("began"), "n")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE ts IS NOT NULL),
s AS (SELECT user_id, event_id, k, true AS allowed, [t] AS kept FROM e WHERE k = 1 UNION ALL
SELECT e.user_id, e.event_id, e.k, len(list_filter(kept, lambda x: t - x < 3600)) < 3, CASE WHEN len(list_filter(kept, lambda x: t - x < 3600)) < 3 THEN list_filter(kept, lambda x: t - x < 3600) || [t] ELSE list_filter(kept, lambda x: t - x < 3600) END FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1)
SELECT user_id, event_id, allowed FROM s UNION ALL SELECT user_id, event_id, false FROM events WHERE ts IS NULL""")
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits that a limiter of 3 an hour and user lets through."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    return allowed_hits(e, "user_id", "event_id", 3, 3600)
