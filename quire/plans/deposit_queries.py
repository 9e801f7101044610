"""The deposit: a bag of all pages with its manifests, as one archive; gazetteers read from archives."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.index import shared_root
from quire.plans.registry import query
from quire.sources import archives, zipped
from quire.streaming.runs import finished
from quire.tables import corpus, table

_BAGIT = "BagIt-Version: 1.0\nTag-File-Character-Encoding: UTF-8\n"
#: Fixed: lines of a manifest in one piece, about.
_LINES = 5000


def bag(pages: DataFrame) -> DataFrame:
    """(name, seq, data): a bag's files in pieces, from pages (book, page, raw): payload, payload manifest, bag-info and bagit.

    A page is a payload file; the manifest's lines come in the order of their hashes, some thousands a piece.
    """
    name = F.concat(F.lit("data/"), "book", F.lit("/"), F.col("page").cast("string"), F.lit(".txt"))
    files = pages.select(name.alias("name"), F.lit(0).cast("long").alias("seq"), F.coalesce(F.col("raw"), F.lit("")).cast("binary").alias("data"))
    n = pages.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("raw")), F.lit(0)).alias("bytes"))
    sums = files.select(F.sha2("data", 256).alias("sha"), "name").crossJoin(F.broadcast(n.select("n")))
    # hashes are even, so ranges of them hold about as many lines each
    piece = F.floor(F.conv(F.left("sha", F.lit(8)), 16, 10).cast("double") / 4294967296.0 * F.ceil(F.col("n") / _LINES)).cast("long")
    lines = sums.select(piece.alias("seq"), F.concat("sha", F.lit("  "), "name", F.lit("\n")).alias("line")).groupBy("seq").agg(F.array_join(F.array_sort(F.collect_list("line")), "").cast("binary").alias("data"))
    info = n.select(F.concat(F.lit("External-Description: Corpus\nPayload-Oxum: "), F.col("bytes").cast("string"), F.lit("."), F.col("n").cast("string"), F.lit("\n")).cast("binary").alias("data"))
    one = lambda df, name: df.select(F.lit(name).alias("name"), F.lit(0).cast("long").alias("seq"), "data")
    bagit = n.select(F.lit(_BAGIT).cast("binary").alias("data"))
    return files.union(lines.select(F.lit("manifest-sha256.txt").alias("name"), "seq", "data")).union(one(info, "bag-info.txt")).union(one(bagit, "bagit.txt"))


_CRC = """tab AS (SELECT list(t ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS t FROM range(256) r(i)))"""
_BAG = f"""WITH {_CRC}, p AS (SELECT 'data/' || source || '/' || doc_id || '.txt' AS name, text AS body FROM documents),
f AS (SELECT * FROM p UNION ALL SELECT 'bagit.txt', 'BagIt-Version: 1.0' || chr(10) || 'Tag-File-Character-Encoding: UTF-8' || chr(10)
UNION ALL SELECT 'bag-info.txt', 'External-Description: Corpus' || chr(10) || 'Payload-Oxum: ' || sum(strlen(text))::BIGINT || '.' || count(*) || chr(10) FROM documents
UNION ALL SELECT 'manifest-sha256.txt', string_agg(line, '' ORDER BY line) FROM (SELECT sha256(body) || '  ' || name || chr(10) AS line FROM p))"""


@query(f"""{_BAG} SELECT name, strlen(body)::BIGINT AS size, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(body)), '..'), lambda x: ('0x' || x)::BIGINT)), lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1])), 4294967295) AS crc32 FROM f, tab""")
def deposit_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deposit's archive, written whole and listed from its own directory."""
    path = f"{shared_root(spark)}/deposits/{uuid.uuid4().hex}"
    archives.write_zip(bag(corpus(spark, sf_dir)), f"{path}/archive", f"{path}/work")
    return archives.listed(spark, f"{path}/archive").select("name", "size", "crc32")


@query(f"{_BAG} SELECT sha256(body) || '  ' || name AS line FROM f WHERE name NOT LIKE 'data/%'")
def bag_tag_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checksums of the tag files. A file in pieces is hashed in their order."""
    tags = bag(corpus(spark, sf_dir)).where(~F.col("name").startswith("data/"))
    return archives.digests(tags).select(F.concat("sha256", F.lit("  "), "name").alias("line"))


_TOWNS = "SELECT n_name || '.txt' AS member, c_custkey || chr(9) || c_name || chr(9) || c_mktsegment AS value FROM customer JOIN nation ON c_nationkey = n_nationkey"


def _towns(spark: SparkSession, sf_dir: str) -> str:
    """A folder with an archive of tables, one member a nation, as gazetteers come."""
    path = f"{shared_root(spark)}/gazetteers/{uuid.uuid4().hex}"
    named = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    lines = named.select(F.concat("n_name", F.lit(".txt")).alias("name"), F.col("c_custkey"), F.concat(F.col("c_custkey").cast("string"), F.lit("\t"), "c_name", F.lit("\t"), "c_mktsegment", F.lit("\n")).alias("line"))
    pieces = lines.groupBy("name", F.floor(F.col("c_custkey") / _LINES).alias("seq")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "line"))), lambda x: x["line"]), "").cast("binary").alias("data"))
    archives.write_zip(pieces, f"{path}/parts", f"{path}/work")
    archives.joined(spark, f"{path}/parts", f"{path}/archives/towns.zip")
    zipped.register(spark)
    return f"{path}/archives"


@query(_TOWNS)
def gazetteer_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a zipped gazetteer's tables, a task each."""
    return spark.read.format("zip_lines").option("path", _towns(spark, sf_dir)).option("members", r"\.txt$").load().select("member", "value")


@query(_TOWNS)
def gazetteer_zip_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream that takes each archive once."""
    return finished(spark.readStream.format("zip_lines").option("path", _towns(spark, sf_dir)).option("members", r"\.txt$").load().select("member", "value"))
