"""Catalogue records, Dublin Core, harvest lists, whole-volume exports, IIIF documents and deposit metadata."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import records as R
from quire.functions import text as T
from quire.operators import harvest as H
from quire.operators import search as S
from quire.operators.index import open_index, shared_root
from quire.plans.corpus_queries import QUERY, _SCORED, _POSTED, _terms
from quire.plans.registry import query
from quire.tables import corpus, table

SITE, PREFIX, STAMP = "archive.example", "oai:quire:", "2024-01-01T00:00:00Z"

#: The catalogue: a volume for every part.
_BOOKS = """books AS (SELECT 'v' || lpad(p_partkey::VARCHAR, 7, '0') AS book, p_name || ' کتاب' AS title, CASE WHEN p_size % 3 > 0 THEN p_brand || ' & Co.' END AS publisher, p_type || '--History' AS subject,
CASE WHEN p_size % 7 > 0 THEN 1850 + p_size END AS lo, CASE WHEN p_size % 7 > 0 THEN 1850 + p_size + p_size % 2 END AS hi, p_size AS pages FROM part)"""


def _books(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, dated = F.col("p_size"), F.col("p_size") % 7 > 0
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("v"), F.lpad(F.col("p_partkey").cast("string"), 7, "0")).alias("book"), F.concat("p_name", F.lit(" کتاب")).alias("title"), F.when(size % 3 > 0, F.concat("p_brand", F.lit(" & Co."))).alias("publisher"),
        F.concat("p_type", F.lit("--History")).alias("subject"), F.when(dated, 1850 + size).alias("lo"), F.when(dated, 1850 + size + size % 2).alias("hi"), size.alias("pages"),
    )


def _core(b: DataFrame) -> Column:
    rec = {"title": F.col("title"), "publisher": F.col("publisher"), "subjects": F.array("subject"), "lo": F.col("lo"), "hi": F.col("hi")}
    return R.dublin_core(F.col("book"), rec, F.col("pages"), SITE, ["Images: public domain", "Text: CC0"], ["fas", "pus"])


_XML = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_DATE = "CASE WHEN lo <> hi THEN lo || '-' || hi ELSE lo::VARCHAR END"
_DC = f"""'<oai_dc:dc>' || chr(10) || '  <dc:title>' || replace(title, ' کتاب', '') || '</dc:title>' || chr(10) || '  <dc:title>کتاب</dc:title>' || chr(10) || '  <dc:subject>' || subject || '</dc:subject>' || chr(10) || '  <dc:description>' || pages || ' pages machine-transcribed at {SITE}</dc:description>' || chr(10)
|| CASE WHEN publisher IS NOT NULL THEN '  <dc:publisher>' || {_XML.format('publisher')} || '</dc:publisher>' || chr(10) ELSE '' END || CASE WHEN lo IS NOT NULL THEN '  <dc:date>' || {_DATE} || '</dc:date>' || chr(10) ELSE '' END
|| '  <dc:type>Text</dc:type>' || chr(10) || '  <dc:format>text/plain</dc:format>' || chr(10) || '  <dc:identifier>https://{SITE}/book/' || book || '</dc:identifier>' || chr(10) || '  <dc:language>fas</dc:language>' || chr(10) || '  <dc:language>pus</dc:language>' || chr(10) || '  <dc:rights>Images: public domain</dc:rights>' || chr(10) || '  <dc:rights>Text: CC0</dc:rights>' || chr(10) || '</oai_dc:dc>'"""
_SET = "CASE WHEN lo IS NOT NULL THEN 'decade:' || (lo // 10) * 10 END"
_HEADER = f"'<header><identifier>{PREFIX}' || book || '</identifier><datestamp>2024-01-01</datestamp>' || coalesce('<setSpec>' || {_SET} || '</setSpec>', '') || '</header>'"


@query(f"WITH {_BOOKS} SELECT book, {_DC} AS xml FROM books")
def dublin_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _books(spark, sf_dir)
    return b.select("book", R.dc_xml(_core(b)).alias("xml"))


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _books(spark, sf_dir)
    return b.select("book", _core(b).alias("dc"), R.decade_sets(F.col("lo")).alias("sets"))


def _page(spark: SparkSession, sf_dir: str, token: str, setspec: str = "", records: bool = True, ranked: bool = False) -> DataFrame:
    if ranked:
        path = f"{shared_root(spark)}/lists/{uuid.uuid4().hex}"
        H.write_ranks(_listed(spark, sf_dir), "book", "sets", path)
        page = H.ranked_page(spark, path, token, setspec)
    else:
        page = H.list_page(_listed(spark, sf_dir), "book", "sets", token, setspec)
    if page is None:
        return spark.createDataFrame([], "nth long, body string, token string")
    rows, after = page
    head = R.header(PREFIX, F.col("book"), STAMP, F.col("sets"))
    body = F.concat(F.lit("<record>"), head, F.lit("<metadata>"), R.dc_xml(F.col("dc")), F.lit("</metadata></record>")) if records else head
    return rows.select(F.col("nth").cast("long").alias("nth"), body.alias("body"), F.lit(after).alias("token"))


def _page_sql(start: int, where: str = "", records: bool = True, spec: str = "") -> str:
    body = f"'<record>' || {_HEADER} || '<metadata>' || {_DC} || '</metadata></record>'" if records else _HEADER
    rest = f"'>' || {start + H.CHUNK} || '{':' + spec if spec else ''}</resumptionToken>'"
    return f"""WITH {_BOOKS}, ranked AS (SELECT *, row_number() OVER (ORDER BY book) - 1 AS nth, count(*) OVER () AS size FROM books {where})
SELECT nth, {body} AS body, '<resumptionToken completeListSize="' || size || '" cursor="{start}"' || CASE WHEN size > {start + H.CHUNK} THEN {rest} ELSE '/>' END AS token FROM ranked WHERE nth >= {start} AND nth < {start + H.CHUNK}"""


@query(_page_sql(0))
def oai_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of records with the token that leads to the next."""
    return _page(spark, sf_dir, "")


@query(_page_sql(100))
def oai_page2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page(spark, sf_dir, "100")


@query(_page_sql(1500))
def oai_page16_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A late page from the list's kept order."""
    return _page(spark, sf_dir, "1500", ranked=True)


@query(_page_sql(100, f"WHERE {_SET} = 'decade:1870'", False, "decade:1870"))
def oai_set_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A set's second page from its kept order."""
    return _page(spark, sf_dir, "100:decade:1870", records=False, ranked=True)


@query(_page_sql(0, f"WHERE {_SET} = 'decade:1870'", False, "decade:1870"))
def oai_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers of one decade's volumes."""
    return _page(spark, sf_dir, "", "decade:1870", False)


@query(f"WITH {_BOOKS} SELECT DISTINCT '<set><setSpec>decade:' || (lo // 10) * 10 || '</setSpec><setName>Published ' || (lo // 10) * 10 || 's</setName></set>' AS body FROM books WHERE lo IS NOT NULL")
def oai_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = (F.floor(F.col("lo") / 10) * 10).cast("string")
    return _books(spark, sf_dir).where("lo IS NOT NULL").select(F.concat(F.lit("<set><setSpec>decade:"), d, F.lit("</setSpec><setName>Published "), d, F.lit("s</setName></set>")).alias("body")).distinct()


@query("""SELECT * FROM (VALUES ('Identify', NULL), ('ListRecords mods', 'cannotDisseminateFormat'), ('ListRecords x:y', 'badResumptionToken'), ('ListRecords 99999999', 'badResumptionToken'), ('ListIdentifiers set', 'noRecordsMatch'), ('GetRecord', NULL), ('GetRecord unknown', 'idDoesNotExist'), ('Other', 'badVerb'), ('ListRecords', NULL)) v(request, code)""")
def oai_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests and what the protocol says is wrong with them."""
    b = _listed(spark, sf_dir)
    page = lambda *a: H.list_page(b, "book", "sets", *a) is not None
    known = lambda i: b.where(F.col("book") == i.removeprefix(PREFIX)).limit(1).count() > 0
    rows = [
        ("Identify", H.error_of("Identify")), ("ListRecords mods", H.error_of("ListRecords", "mods")), ("ListRecords x:y", H.error_of("ListRecords", token="x:y", found=page("x:y"))),
        ("ListRecords 99999999", H.error_of("ListRecords", token="99999999", found=page("99999999"))), ("ListIdentifiers set", H.error_of("ListIdentifiers", "oai_dc", found=page("", "decade:1500"))),
        ("GetRecord", H.error_of("GetRecord", "oai_dc", known(f"{PREFIX}v0000001"))), ("GetRecord unknown", H.error_of("GetRecord", "oai_dc", known(f"{PREFIX}none"))), ("Other", H.error_of("Other")), ("ListRecords", H.error_of("ListRecords", "oai_dc", found=page())),
    ]
    return spark.createDataFrame(rows, "request string, code string")


@query(f"""WITH {_BOOKS} SELECT book, '<meta name="DC.title" content="' || replace(title, ' کتاب', '') || '"/>' AS title, CASE WHEN lo IS NOT NULL THEN '<meta name="DC.date" content="' || replace({_DATE}, '-', '/') || '"/>' END AS date FROM books""")
def page_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and date elements of a volume's page head."""
    b = _books(spark, sf_dir)
    m = b.select("book", F.split(R.dc_meta(_core(b)), "\n").alias("m"))
    return m.select("book", F.get("m", 0).alias("title"), F.get(F.filter("m", lambda x: x.contains("DC.date")), 0).alias("date"))


@query(f"""WITH {_BOOKS} SELECT book, 'ctx_ver=Z39.88-2004&rft.btitle=' || replace(replace(title, ' کتاب', ''), ' ', '+') || coalesce('&rft.date=' || lo, '') AS coins,
'{{"@type":"Book","name":"' || replace(title, ' کتاب', '') || '"' || coalesce(',"datePublished":"' || lo || '"', '') || ',"numberOfPages":' || pages || '}}' AS json_ld FROM books""")
def page_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The context object and the linked data of a volume's page."""
    name = R.title_parts(F.col("title"))["romanized"]
    coins = F.concat(F.lit("ctx_ver=Z39.88-2004&rft.btitle="), F.url_encode(name), F.coalesce(F.concat(F.lit("&rft.date="), F.col("lo").cast("string")), F.lit("")))
    ld = F.to_json(F.struct(F.lit("Book").alias("@type"), name.alias("name"), F.col("lo").cast("string").alias("datePublished"), F.col("pages").alias("numberOfPages")))
    return _books(spark, sf_dir).select("book", coins.alias("coins"), ld.alias("json_ld"))


#: Record pages made from the catalogue: labels, a second script, breaks, links, entities, an unknown label and rows that aren't of a record.
_HTML = """'<table><tr><td><img src="c.jpg"/></td></tr><tr><td class="label">Title:</td> <td class="value">' || p_name || ' &amp; <i>more</i></td></tr><tr><td> </td><td class="value arabic">کتاب' || chr(8207) || '</td></tr>' ||
'<tr><td class="label">Subject(s):</td><td class="value">' || p_type || '--History<br/>Press<BR> </td></tr><tr><td class="label">Publisher:</td><td>Kabul, [' || (1850 + p_size) || ']</td></tr><tr><td class="label">Citation Link:</td><td><a href="http://hdl/' || p_partkey || '">link</a></td></tr><tr><td class="label">Shelf Mark:</td><td class="value">' || p_brand || '</td></tr></table>'"""


@query("""SELECT p_partkey, p_name || ' & more' AS title, 'کتاب' AS title_original, p_type || '--History|Press' AS subjects, 'Kabul, [' || (1850 + p_size) || ']' AS publisher, 'http://hdl/' || p_partkey AS handle, p_brand AS shelf_mark, (1850 + p_size)::INT AS year_start FROM part""")
def html_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record pages parsed into fields, with the years of their publishers."""
    from quire.functions import catalogue as C

    pages = S.spread(table(spark, sf_dir, "part")).select("p_partkey", F.expr(_HTML.replace("chr(8207)", "'‏'")).alias("html"))
    r = R.with_record(pages, "html", "r")
    one = lambda k: R.first(F.col("r")[k]).alias(k)
    return r.select("p_partkey", one("title"), one("title_original"), F.array_join(F.col("r")["subjects"], "|").alias("subjects"), one("publisher"), one("handle"), one("shelf_mark"), C.years(R.first(F.col("r")["publisher"]))["year_start"].alias("year_start"))


_THIN = """'<table>' || CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN '<tr><td class="label">Title:</td><td> <br/> </td></tr>' ELSE '<tr><td class="label">Title:</td><td class="value">' || p_name || '</td></tr>' END || CASE WHEN p_partkey % 4 = 2 THEN '<tr><td></td><td class="value Arabic">سراج</td></tr>' ELSE '' END ||
CASE WHEN p_partkey % 4 = 1 OR p_partkey % 8 = 3 THEN '<tr><td class="label">Other Titles:</td><td>' || p_type || '<br>' || p_brand || '</td></tr>' ELSE '' END || '</table>'"""


@query("""WITH t AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN p_type ELSE p_name END AS own, CASE WHEN p_partkey % 4 = 2 THEN 'سراج' END AS original FROM part)
SELECT p_partkey, own || coalesce(' ' || original, '') AS title, own AS title_romanized, original AS title_original, CASE WHEN p_partkey % 4 = 1 THEN 'other_titles' END AS title_source, CASE WHEN own IS NULL THEN 'no title' END AS problem, coalesce(own, '') AS romanized FROM t""")
def html_record_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of record pages, from the other titles where a page has none; a page with neither is told by its problem, and stays."""
    pages = S.spread(table(spark, sf_dir, "part")).select("p_partkey", F.expr(_THIN).alias("html"))
    t = R.with_record(pages, "html", "r").select("p_partkey", R.titled(F.col("r")).alias("t"))
    return t.select("p_partkey", "t.*", R.title_parts(F.col("t.title"), F.col("t.title_romanized"), F.col("t.title_original"))["romanized"].alias("romanized"))


_ROWS = "list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '')"


def _volume(spark: SparkSession, sf_dir: str, opening: str, page: Column, closing: str) -> DataFrame:
    """(book, seq, body): a volume as its opening, its pages in order and its closing; a volume is many rows, so none holds a whole one."""
    c = corpus(spark, sf_dir)
    ends = c.select("book").distinct().select("book", F.explode(F.array(F.struct(F.lit(-1).cast("long").alias("seq"), F.replace(F.lit(opening), F.lit("{book}"), F.col("book")).alias("body")), F.struct(F.lit(2**62).alias("seq"), F.lit(closing).alias("body")))).alias("e")).select("book", "e.*")
    return c.select("book", F.col("page").cast("long").alias("seq"), page.alias("body")).unionByName(ends)


def _digest(df: DataFrame) -> DataFrame:
    return df.select("book", "seq", F.md5(F.col("body").cast("binary")).alias("body"))


def _volume_sql(opening: str, page: str, closing: str) -> str:
    return f"""SELECT source AS book, doc_id AS seq, md5({page}) AS body FROM documents UNION ALL SELECT DISTINCT source, -1, md5(replace('{opening}', '{{book}}', source)) FROM documents UNION ALL SELECT DISTINCT source, {2**62}, md5('{closing}') FROM documents"""


_ALTO = ('<?xml version="1.0" encoding="UTF-8"?><alto xmlns="http://www.loc.gov/standards/alto/ns-v4#"><Description><MeasurementUnit>pixel</MeasurementUnit><sourceImageInformation><fileName>{book}</fileName></sourceImageInformation></Description><Layout>', "</Layout></alto>")
_BOX = 'HPOS="0" VPOS="0" WIDTH="1000" HEIGHT="1400"'


@query(_volume_sql(_ALTO[0], f"""'<Page ID="P' || doc_id || '" PHYSICAL_IMG_NR="' || doc_id || '" WIDTH="1000" HEIGHT="1400"><PrintSpace {_BOX}><TextBlock ID="P' || doc_id || '_B1" {_BOX}>' || array_to_string(list_transform({_ROWS}, lambda x, i: '<TextLine ID="P' || doc_id || '_L' || i || '" {_BOX}><String ID="P' || doc_id || '_L' || i || '_S1" CONTENT="' || replace({_XML.format('x')}, '"', '&quot;') || '" {_BOX}/></TextLine>'), '') || '</TextBlock></PrintSpace></Page>'""", _ALTO[1]))
def volume_alto(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("page").cast("string")
    line = lambda x, i: F.concat(F.lit('<TextLine ID="P'), p, F.lit("_L"), (i + 1).cast("string"), F.lit(f'" {_BOX}><String ID="P'), p, F.lit("_L"), (i + 1).cast("string"), F.lit('_S1" CONTENT="'), T.xml_escape(x, True), F.lit(f'" {_BOX}/></TextLine>'))
    page = F.concat(F.lit('<Page ID="P'), p, F.lit('" PHYSICAL_IMG_NR="'), p, F.lit(f'" WIDTH="1000" HEIGHT="1400"><PrintSpace {_BOX}><TextBlock ID="P'), p, F.lit(f'_B1" {_BOX}>'), F.array_join(F.transform(T.full_lines(F.col("raw")), line), ""), F.lit("</TextBlock></PrintSpace></Page>"))
    return _digest(_volume(spark, sf_dir, _ALTO[0], page, _ALTO[1]))


_HOCR = ('<!DOCTYPE html><html xmlns="http://www.w3.org/1999/xhtml"><head><meta charset="utf-8"/><title>{book}</title><meta name="ocr-capabilities" content="ocr_page ocr_carea ocr_line"/></head><body>', "</body></html>")


@query(_volume_sql(_HOCR[0], f"""'<div class="ocr_page" id="page_' || doc_id || '" title="bbox 0 0 1000 1400; ppageno ' || doc_id || '"><div class="ocr_carea" id="block_' || doc_id || '_1" title="bbox 0 0 1000 1400">' || array_to_string(list_transform({_ROWS}, lambda x, i: '<span class="ocr_line" id="line_' || doc_id || '_' || i || '">' || {_XML.format('x')} || '</span>'), chr(10)) || '</div></div>'""", _HOCR[1]))
def volume_hocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("page").cast("string")
    line = lambda x, i: F.concat(F.lit('<span class="ocr_line" id="line_'), p, F.lit("_"), (i + 1).cast("string"), F.lit('">'), T.xml_escape(x), F.lit("</span>"))
    page = F.concat(F.lit('<div class="ocr_page" id="page_'), p, F.lit('" title="bbox 0 0 1000 1400; ppageno '), p, F.lit('"><div class="ocr_carea" id="block_'), p, F.lit('_1" title="bbox 0 0 1000 1400">'), F.array_join(F.transform(T.full_lines(F.col("raw")), line), "\n"), F.lit("</div></div>"))
    return _digest(_volume(spark, sf_dir, _HOCR[0], page, _HOCR[1]))


_TEI = ('<?xml version="1.0" encoding="UTF-8"?><TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title>{book}</title></titleStmt><publicationStmt><publisher>archive.example</publisher></publicationStmt><sourceDesc><bibl><idno>{book}</idno></bibl></sourceDesc></fileDesc></teiHeader><text><body><div>', "</div></body></text></TEI>")


@query(_volume_sql(_TEI[0], f"""'<pb n="' || doc_id || '" facs="#f' || doc_id || '"/>' || array_to_string(list_transform({_ROWS}, lambda x: '<l>' || {_XML.format('x')} || '</l>'), chr(10))""", _TEI[1]))
def volume_tei(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("page").cast("string")
    line = lambda x: F.concat(F.lit("<l>"), T.xml_escape(x), F.lit("</l>"))
    page = F.concat(F.lit('<pb n="'), p, F.lit('" facs="#f'), p, F.lit('"/>'), F.array_join(F.transform(T.full_lines(F.col("raw")), line), "\n"))
    return _digest(_volume(spark, sf_dir, _TEI[0], page, _TEI[1]))


_CANVAS = "https://archive.example/iiif/"


@query(f"""SELECT doc_id AS page, md5('{{"id":"{_CANVAS}' || source || '/canvas/' || doc_id || '","type":"Canvas","height":1400,"width":1000,"label":{{"none":["' || doc_id || '"]}},"image":"https://images/' || source || '/' || lpad(doc_id::VARCHAR, greatest(5, length(doc_id::VARCHAR))::INT, '0') || '.jpg","annotations":"{_CANVAS}' || source || '/canvas/' || doc_id || '/text"}}') AS canvas FROM documents""")
def iiif_canvases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest's canvases, one row each: sizes, label, image and the page of its text."""
    from quire.functions import layout as L

    c = corpus(spark, sf_dir)
    own = F.concat(F.lit(_CANVAS), "book", F.lit("/canvas/"), F.col("page").cast("string"))
    canvas = F.struct(own.alias("id"), F.lit("Canvas").alias("type"), F.lit(1400).alias("height"), F.lit(1000).alias("width"), F.struct(F.array(F.col("page").cast("string")).alias("none")).alias("label"), L.page_image("https://images", F.col("book"), F.col("page")).alias("image"), F.concat(own, F.lit("/text")).alias("annotations"))
    return c.select("page", F.md5(F.to_json(canvas).cast("binary")).alias("canvas"))


@query(f"""SELECT DISTINCT source AS book, '{{"id":"{_CANVAS}' || source || '/manifest","type":"Manifest","label":{{"en":["' || source || '"]}}}}' AS item FROM documents""")
def iiif_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The collection's items: a manifest for every volume."""
    item = F.struct(F.concat(F.lit(_CANVAS), "book", F.lit("/manifest")).alias("id"), F.lit("Manifest").alias("type"), F.struct(F.array("book").alias("en")).alias("label"))
    return corpus(spark, sf_dir).select("book").distinct().select("book", F.to_json(item).alias("item"))


@query("""SELECT doc_id AS page, md5('{"type":"TextualBody","format":"text/plain","language":"fa","value":' || to_json(text) || '}') AS annotation FROM documents""")
def iiif_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's text as a supplementing annotation."""
    c = corpus(spark, sf_dir)
    body = F.struct(F.lit("TextualBody").alias("type"), F.lit("text/plain").alias("format"), F.lit("fa").alias("language"), F.col("raw").alias("value"))
    return c.select("page", F.md5(F.to_json(body).cast("binary")).alias("annotation"))


@query(f"""WITH {_POSTED}, {_terms(QUERY)}, terms AS (SELECT * FROM asked), {_SCORED}, top AS (SELECT * FROM scored ORDER BY score, id LIMIT 300),
met AS (SELECT i.id, book, score, (SELECT count(*) FILTER (contains(i.txt, term)) / count(*) FROM terms) AS coverage FROM top JOIN indexed i USING (id)), found AS (SELECT * FROM met WHERE coverage >= 0.34 ORDER BY score, id LIMIT 100)
SELECT '{_CANVAS}search/anno/' || book || '/' || id AS id, '{_CANVAS}' || book || '/canvas/' || id AS target, (SELECT count(*) FROM found) AS total FROM found""")
def iiif_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A content search's annotations: their names, canvases and how many there are."""
    found = S.search_trigram(open_index(corpus(spark, sf_dir)), QUERY, 100)
    total = found.agg(F.count(F.lit(1)).alias("total"))
    i = F.col("id").cast("string")
    return found.crossJoin(F.broadcast(total)).select(F.concat(F.lit(f"{_CANVAS}search/anno/"), "book", F.lit("/"), i).alias("id"), F.concat(F.lit(_CANVAS), "book", F.lit("/canvas/"), i).alias("target"), "total")


@query("""SELECT '<resource><titles><title>Corpus</title></titles><publicationYear>2024</publicationYear><sizes><size>' || count(*) || ' pages</size><size>' || count(DISTINCT source) || ' volumes</size></sizes></resource>' AS datacite,
'cff-version: 1.2.0' || chr(10) || 'title: Corpus' || chr(10) || 'abstract: ' || count(*) || ' pages in ' || count(DISTINCT source) || ' volumes' AS cff, '{"pages":' || count(*) || ',"volumes":' || count(DISTINCT source) || ',"chars":' || sum(n_chars)::BIGINT || '}' AS summary FROM documents""")
def deposit_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deposit's metadata, citation file and summary, from the corpus' own counts."""
    n = corpus(spark, sf_dir).agg(F.count(F.lit(1)).alias("pages"), F.countDistinct("book").alias("volumes"), F.sum("nchars").alias("chars"))
    p, v = F.col("pages").cast("string"), F.col("volumes").cast("string")
    xml = F.concat(F.lit("<resource><titles><title>Corpus</title></titles><publicationYear>2024</publicationYear><sizes><size>"), p, F.lit(" pages</size><size>"), v, F.lit(" volumes</size></sizes></resource>"))
    cff = F.concat(F.lit("cff-version: 1.2.0\ntitle: Corpus\nabstract: "), p, F.lit(" pages in "), v, F.lit(" volumes"))
    return n.select(xml.alias("datacite"), cff.alias("cff"), F.to_json(F.struct("pages", "volumes", "chars")).alias("summary"))


@query(f"""WITH {_BOOKS} SELECT (lo // 10) * 10 AS decade, book, replace(title, ' کتاب', '') AS romanized, row_number() OVER (PARTITION BY (lo // 10) * 10 ORDER BY lower(replace(title, ' کتاب', '')), book) AS nth FROM books WHERE lo IS NOT NULL""")
def browse_decade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each decade's titles in order of their romanised form."""
    b = _books(spark, sf_dir).where("lo IS NOT NULL").select((F.floor(F.col("lo") / 10) * 10).alias("decade"), "book", R.title_parts(F.col("title"))["romanized"].alias("romanized"))
    return b.withColumn("nth", F.row_number().over(Window.partitionBy("decade").orderBy(F.lower("romanized"), "book")))


@query(f"WITH {_BOOKS} SELECT book, replace(title, ' کتاب', '') AS romanized FROM books WHERE regexp_replace(regexp_replace(lower(split_part(subject, '--', 1)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') = 'economy'")
def browse_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles under a subject's slug."""
    return _books(spark, sf_dir).where(T.slug(F.split_part("subject", F.lit("--"), F.lit(1))) == "economy").select("book", R.title_parts(F.col("title"))["romanized"].alias("romanized"))


@query(f"WITH {_BOOKS} SELECT d.doc_id, coalesce(replace(title, ' کتاب', ''), 'v' || lpad(d.doc_id::VARCHAR, 7, '0')) AS label FROM documents d LEFT JOIN books b ON b.book = 'v' || lpad((d.doc_id * 2)::VARCHAR, 7, '0')")
def page_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with their volume's title where the catalogue has one, else its number. The catalogue's size decides how they meet."""
    b = _books(spark, sf_dir).select("book", R.title_parts(F.col("title"))["romanized"].alias("title"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("v"), F.lpad((F.col("doc_id") * 2).cast("string"), 7, "0")).alias("book"))
    return d.join(b, "book", "left").select("doc_id", F.coalesce("title", F.concat(F.lit("v"), F.lpad(F.col("doc_id").cast("string"), 7, "0"))).alias("label"))
