"""Weighted rendezvous hashing of stable record keys over shards, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm._common import documents

SHARDS = 24
BUCKETS = 256


def _unit(key: Column, salt: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of md5(key/salt)."""
    digits = F.conv(F.substring(F.md5(F.concat_ws("/", key, salt).cast("binary")), 1, 13), 16, 10)
    return (digits.cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def scores(key: Column, weights: Sequence[float]) -> Column:
    """An array of (score, -shard): w / -ln(u) for every shard; its largest element names the owner.

    A shard's score for a key depends on nothing else, so a new shard only takes keys it wins and a
    removed one only gives its own away. Weights are in proportion to the shares.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive and not empty")
    shards = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(w)).alias("w")) for i, w in enumerate(weights)])
    return F.transform(shards, lambda s: F.struct((s["w"] / -F.log(_unit(key, s["i"].cast("string")))).alias("score"), (-s["i"]).alias("neg")))


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a key. Ties go to the smaller shard; a null key is a key of its own."""
    return (-F.array_max(scores(key, weights))["neg"]).cast("int")


def shard(df: DataFrame, key: str, weights: Sequence[float], grown: Sequence[float] | None = None, order: Sequence[str] = (), buckets: int = BUCKETS) -> DataFrame:
    """Add ``shard``, ``slot`` (gapless from 0 in each shard) and, with grown weights, ``grown_shard``.

    Slots come from two steps, so that no shard is ever sorted as a whole: rows are numbered within
    ``buckets`` hash buckets of a shard, and prefix sums over the bucket counts (at most shards x buckets
    rows, hence broadcast) give each bucket its base. Nulls, ties and repeated rows are numbered like any
    other row; an empty table gives an empty one. Columns of df that bear the added names are replaced.
    """
    grown = list(grown or ())
    if grown and list(grown[: len(weights)]) != list(weights):
        raise ValueError("grown weights must extend the weights")
    k = F.col(key).cast("string")
    added = ["shard", "slot", "grown_shard", "__bucket", "__scores", "__base"]
    rows = df.drop(*added).withColumn("__scores", scores(k, grown or weights))
    rows = rows.withColumns({
        "shard": (-F.array_max(F.slice("__scores", 1, len(weights)))["neg"]).cast("int"),
        "grown_shard": (-F.array_max("__scores")["neg"]).cast("int") if grown else F.lit(None).cast("int"),
        "__bucket": F.floor(_unit(k, F.lit("slot")) * buckets).cast("int"),
    }).drop("__scores")
    counts = rows.groupBy("shard", "__bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("shard", "__bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy("shard", "__bucket").orderBy(F.col(key), *[F.col(c) for c in order])
    numbered = rows.withColumn("slot", F.row_number().over(inside).cast("long"))
    joined = numbered.join(F.broadcast(bases), ["shard", "__bucket"])
    return joined.withColumn("slot", F.col("slot") - 1 + F.col("__base")).drop("__bucket", "__base")


def op1_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document to one of 24 equal shards by its doc_id; grown_shard is its place among 25."""
    text = F.col("text").cast("binary")
    rows = documents(spark, sf_dir).select("doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit("").cast("binary"))).alias("text_crc32"))
    out = shard(rows, "doc_id", [1.0] * SHARDS, [1.0] * (SHARDS + 1), ["size", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


#: The same in DuckDB: CRC-32 from its polynomial, rendezvous scores from the same hash, slots by the same order.
OP1_SQL = f"""WITH tab AS (SELECT list(t ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS t FROM range(256) r(i))),
b AS (SELECT doc_id, coalesce(strlen(text), 0) + 8 AS size, list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT)) AS bytes FROM documents),
c AS (SELECT doc_id, size, xor(list_reduce(bytes, lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1])), 4294967295) AS text_crc32 FROM b, tab),
s AS (SELECT doc_id, size, text_crc32, list_transform(range({SHARDS + 1}), lambda i: 1.0 / -ln((('0x' || left(md5(doc_id || '/' || i), 13))::BIGINT + 0.5) / 4503599627370496.0)) AS score,
floor((('0x' || left(md5(doc_id || '/slot'), 13))::BIGINT + 0.5) / 4503599627370496.0 * {BUCKETS})::INT AS bucket FROM c),
w AS (SELECT doc_id, size, text_crc32, bucket, list_position(score[1:{SHARDS}], list_max(score[1:{SHARDS}])) - 1 AS shard, list_position(score, list_max(score)) - 1 AS grown_shard FROM s)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INT AS shard, row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id, size, text_crc32) - 1 AS slot, grown_shard::INT AS grown_shard FROM w"""
