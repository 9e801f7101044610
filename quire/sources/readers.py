"""Readers: tolerant and strict JSON lines, whole JSON documents, tab-separated tables, gazetteers, prediction shards, zipped members."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

GAZETTEER = "geonameid string, name string, ascii string, variants string, lat double, lon double, class string, code string, country string, cc2 string, a1 string, a2 string, a3 string, a4 string, population long"


def json_lines(spark: SparkSession, path: str, schema: str, key: str | None = None, strict: bool = False) -> DataFrame:
    """One object a line. Malformed lines, and those without the key, are left out; strict fails on them."""
    df = spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)
    return df.where(F.col(key).isNotNull()) if key and not strict else df


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A whole JSON document; a missing or invalid one is an empty table, never an error."""
    try:
        return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def work_list(spark: SparkSession, path: str) -> DataFrame:
    """(book, pages) of a table with a header: book or id, then pages, images or est_pages; what isn't a number is 0."""
    df = spark.read.csv(path, sep="\t", header=True)
    first = lambda *names: F.coalesce(*[F.col(n) for n in names if n in df.columns], F.lit(None).cast("string"))
    return df.select(first("book", "id").alias("book"), F.coalesce(first("pages", "images", "est_pages").try_cast("int"), F.lit(0)).alias("pages")).where("book IS NOT NULL")


def gazetteer(spark: SparkSession, path: str, named: dict[str, list[str]], home: str, codes: list[str], least: int = 20_000) -> DataFrame:
    """Settlements that matter: at home by population or seat, abroad by name; each with an Arabic-script variant."""
    g = spark.read.csv(path, sep="\t", schema=GAZETTEER, quote="").where("class = 'P'")
    variants = F.filter(F.split(F.coalesce("variants", F.lit("")), ","), lambda v: v.rlike("[؀-ۿ]"))
    keep = (F.col("country") == home) & ((F.col("population") >= least) | F.col("code").isin(codes))
    for country, names in named.items():
        keep |= (F.col("country") == country) & F.col("name").isin(names)
    return g.where(keep).select("geonameid", "name", "country", F.col("code").alias("feature"), "lat", "lon", "population", variants.alias("variants")).where(F.size("variants") > 0)


def predictions(spark: SparkSession, path: str, books: DataFrame) -> DataFrame:
    """(book, page, text, status, tok_in, tok_out) of sharded batch output. The page comes from the echoed address, never from a line's place."""
    usage = "promptTokenCount long, candidatesTokenCount long, thoughtsTokenCount long, totalTokenCount long"
    raw = spark.read.option("recursiveFileLookup", True).text(path)
    j = lambda p: F.get_json_object("value", p)
    uri = F.coalesce(j("$.request.contents[0].parts[0].fileData.fileUri"), j("$.request.contents[0].parts[0].file_data.file_uri"))
    u = F.from_json(j("$.response.usageMetadata"), usage)
    out = F.greatest(F.coalesce(u["candidatesTokenCount"], F.lit(0)) + F.coalesce(u["thoughtsTokenCount"], F.lit(0)), F.coalesce(u["totalTokenCount"], F.lit(0)) - F.coalesce(u["promptTokenCount"], F.lit(0)))
    rows = raw.select(uri.alias("uri"), F.coalesce(j("$.response.candidates[0].content.parts[0].text"), F.lit("")).alias("text"), j("$.status").alias("status"), F.coalesce(u["promptTokenCount"], F.lit(0)).alias("tok_in"), out.alias("tok_out")).where("uri IS NOT NULL")
    return rows.join(books, "uri", "left").select(F.coalesce("book", F.lit("")).alias("book"), F.regexp_extract("uri", r"(\d+)\.[^/]*$", 1).try_cast("int").alias("page"), "text", "status", "tok_in", "tok_out")


def zip_members(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(path, member, content) of the members of zip files whose names match."""
    def unzip(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for where, content in zip(pdf["path"], pdf["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in z.namelist():
                        if re.search(pattern, name):
                            yield pd.DataFrame({"path": [where], "member": [name], "content": [z.read(name)]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(unzip, "path string, member string, content binary")


def paired_texts(spark: SparkSession, path: str, each: int = 20, least: int = 15) -> DataFrame:
    """(folder, stem, ref, image): texts ``*.gt.txt`` below path that have an image of their name beside them and enough characters, the first ``each`` of a folder by name."""
    name = r"^(.*/)([^/]+)/([^/]+)\.(gt\.txt|png)$"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    cut = files.select("path", *[F.regexp_extract("path", name, i).alias(c) for i, c in ((2, "folder"), (3, "stem"), (4, "kind"))], "content")
    texts = cut.where("kind = 'gt.txt'").select("folder", "stem", F.trim(F.decode("content", "UTF-8")).alias("ref")).where(F.length("ref") >= least)
    images = cut.where("kind = 'png'").select("folder", "stem", F.col("path").alias("image"))
    both = texts.join(images, ["folder", "stem"])
    return both.withColumn("nth", F.row_number().over(Window.partitionBy("folder").orderBy("stem"))).where(F.col("nth") <= each).drop("nth")


def zipped_pages(spark: SparkSession, table: str, archives: str, script: str, style: str, least: int = 60, most: int = 40) -> DataFrame:
    """(doc, ref, image): pages of nested archives whose row in a table with a header names the script, the style and a count over 0.

    A row's ``doc`` names its archive, which is a zip or a zip within one. The page's text and image are members of its name, or else
    members that hold it; the text is the ALTO contents joined, of ``least`` characters or more.
    """
    rows = spark.read.csv(table, sep="\t", header=True).where((F.col("language") == script) & (F.lower("style").contains(style.lower())) & (F.col("count").try_cast("int") > 0)).select("doc", "page")

    def members(where: str, content: bytes) -> Iterator[tuple[str, str, bytes]]:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for name in z.namelist():
                if name.lower().endswith(".zip"):
                    yield from members(name, z.read(name))
                else:
                    yield re.sub(r"^.*/|\.zip$", "", where), name, z.read(name)

    def unzip(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for where, content in zip(pdf["path"], pdf["content"], strict=True):
                for doc, name, body in members(where, content):
                    yield pd.DataFrame({"doc": [doc], "member": [name], "content": [body]})

    found = spark.read.format("binaryFile").load(archives).select("path", "content").mapInPandas(unzip, "doc string, member string, content binary")
    stem = F.regexp_extract("member", r"([^/]+)\.[^./]+$", 1)
    met = rows.join(found, "doc").where(F.col("member").contains(F.col("page"))).withColumn("other", (stem != F.col("page")).cast("int"))
    best = lambda kind: met.where(F.lower("member").rlike(kind)).groupBy("doc", "page").agg(F.min_by(F.struct("member", "content"), F.struct("other", "member")).alias("m"))
    text = best(r"\.xml$").select("doc", "page", alto_text(F.decode("m.content", "UTF-8")).alias("ref")).where(F.length("ref") >= least)
    return text.join(best(r"\.(png|jpe?g|tiff?)$").select("doc", "page", F.col("m.member").alias("image")), ["doc", "page"]).orderBy("doc", "page").limit(most)


def gold_pages(spark: SparkSession, path: str, least: int = 80, most: int = 40) -> DataFrame:
    """(book, page, gold) of tolerant JSON lines: the first row of each page by its place in the file, with enough gold text."""
    raw = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("at"))
    rows = raw.select("at", F.from_json("value", "book string, page int, gold string").alias("r")).select("at", "r.*").where("book IS NOT NULL AND page IS NOT NULL").where(F.length(F.coalesce("gold", F.lit(""))) >= least)
    return rows.groupBy("book", "page").agg(F.min_by("gold", "at").alias("gold"), F.min("at").alias("at")).orderBy("at").limit(most).select("book", "page", "gold")


def directory_links(html: Column, pattern: str = r'href="([A-Za-z]+\d+)/"') -> Column:
    """The distinct entries of a directory page, in order."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(html, F.lit(pattern), 1)))


def alto_text(xml: Column) -> Column:
    """The CONTENT attributes of an ALTO document, joined by blanks."""
    return F.array_join(F.regexp_extract_all(xml, F.lit('CONTENT="([^"]*)"'), 1), " ")
