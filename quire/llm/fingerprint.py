"""Order MinHash document fingerprints.

A text's k-mers are numbered by occurrence. A hash of each (k-mer, number) puts it into one of m bins and
ranks it there; in each bin the l smallest are selected, put back into the text's order, and their k-mers
hashed as a tuple. Equal tuples in equal bins need the same selection in the same order, so the share of
equal bins falls with edit distance. A bin with fewer than l members goes on into the following bins, so
short texts have whole signatures too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm._common import documents, slices


@dataclass(frozen=True)
class Settings:
    """k: code points of a k-mer. bins: tuples of a signature (a power of two). chosen: k-mers of a tuple. bits: of a tuple's hash in the fingerprint."""

    k: int = 8
    bins: int = 64
    chosen: int = 2
    bits: int = 16


#: Text of a part, about: parts are streamed, so this bounds a task's time and not its memory.
PART_BYTES = 64_000_000
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def _kmers(text: str, k: int) -> np.ndarray:
    """Hashes of all k-mers in text order; a text of fewer than k code points is one k-mer, an empty one none."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if not len(code):
        return code
    k = min(k, len(code))
    n = len(code) - k + 1
    h = np.full(n, np.uint64(k))
    for i in range(k):
        h = h * _A + code[i : i + n]
    return _mix(h)


def _numbered(kmers: np.ndarray) -> np.ndarray:
    """Hashes of (k-mer, how many equal ones stand before it)."""
    n = len(kmers)
    width = np.uint64(max(1, int(n - 1).bit_length()))
    packed = np.sort((kmers >> width << width) | np.arange(n, dtype=np.uint64))  # by k-mer, then place
    place = (packed & ((np.uint64(1) << width) - np.uint64(1))).astype(np.int64)
    group = packed >> width
    new = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    nth = np.arange(n) - np.repeat(new, np.diff(np.r_[new, n]))
    out = np.empty(n, np.uint64)
    out[place] = _mix(kmers[place] + nth.astype(np.uint64) * _A)
    return out


def signature(text: str, s: Settings = Settings()) -> np.ndarray:
    """The bins' tuple hashes, as unsigned 16- or 32-bit numbers."""
    kmers = _kmers(text, s.k)
    n, kind = len(kmers), np.dtype(f"u{s.bits // 8}")
    if not n:
        return np.zeros(s.bins, kind)
    ranks = _numbered(kmers)
    shift = np.uint64(64 - (s.bins - 1).bit_length())
    inside = ranks & ((np.uint64(1) << shift) - np.uint64(1))
    at = np.arange(n)
    # Only ranks small enough matter: a bin is expected to have 8 l of them; where one has fewer than l, all are taken.
    part = 8 * s.chosen * s.bins / n
    if part < 1:
        some = np.flatnonzero(inside < np.uint64(int(part * (1 << int(shift)))))
        if np.bincount((ranks[some] >> shift).astype(np.int64), minlength=s.bins).min() >= s.chosen:
            at = some
    order = at[np.argsort(ranks[at])]  # by bin, then rank
    bins = (ranks[order] >> shift).astype(np.int64)
    first = np.searchsorted(bins, np.arange(s.bins))
    picked = np.sort(order[(first[:, None] + np.arange(s.chosen)) % len(order)], axis=1)  # in the text's order
    out = np.zeros(s.bins, np.uint64)
    for i in range(s.chosen):
        out = _mix(out * _A + kmers[picked[:, i]])
    return (out >> np.uint64(64 - s.bits)).astype(kind)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of equal bins, 0 to 1."""
    return float((a == b).mean())


def fingerprint_hex(sig: np.ndarray) -> str:
    return sig.astype(sig.dtype.newbyteorder(">")).tobytes().hex()


def edited(text: str, following: str) -> str:
    """The last third of the text gives way to as many code points from the start of the following one, or all it has."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def compare_neighbours(df: DataFrame, key: str, text: str, s: Settings = Settings(), parts: int | None = None) -> DataFrame:
    """Fingerprints of every text and its edited text, in descending key order; after the last comes the first.

    Rows are dealt once by key range, in parts of PART_BYTES of text or so, and streamed in order. A part's last row needs
    the next part's first: that row goes to both, and only the parts' numbers reach the driver. Null texts count as empty;
    null keys come last; rows with equal keys are ordered by text. A table of one row has itself as the next. An empty
    table gives an empty one. Other columns play no part, whatever their names.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = df.sparkSession
    kind = df.schema[key].dataType
    arrow = to_arrow_type(kind)
    rows = df.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    if not parts:
        size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        parts = max(8, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    # Part edges from the keys alone, so that both passes cut alike.
    found = rows.agg(F.percentile_approx("key", [i / parts for i in range(1, parts)], max(10_000, 4 * parts)).alias("p")).first()["p"] or []
    edges = sorted(set(found))
    shared = spark.sparkContext.broadcast(np.array(edges))

    @F.pandas_udf("int")
    def part_of(keys: pd.Series) -> pd.Series:
        at = len(shared.value) - np.searchsorted(shared.value, keys.dropna().to_numpy(shared.value.dtype), side="right")
        return pd.Series(len(shared.value) + 1, keys.index).where(keys.isna(), pd.Series(at, keys.dropna().index).reindex(keys.index, fill_value=0)).astype("int32")

    nothing = F.col("key").isNull()
    part = F.when(nothing, len(edges) + 1).otherwise(part_of("key")) if edges else nothing.cast("int")
    dealt = rows.withColumn("part", part)
    # The first row of each part, that is the largest key and of equal ones the smallest text.
    firsts = dealt.groupBy("part").agg(F.max("key").alias("k"))
    there = sorted(r["part"] for r in firsts.select("part").collect())  # small numbers, one a part
    before = spark.createDataFrame([(p, there[i - 1]) for i, p in enumerate(there)], "p int, before int")
    heads = dealt.join(F.broadcast(firsts.withColumnRenamed("part", "p")), (F.col("part") == F.col("p")) & F.col("key").eqNullSafe(F.col("k"))).groupBy("part").agg(F.min("text").alias("text"))
    heads = heads.join(F.broadcast(before), F.col("part") == F.col("p")).select(F.lit(None).cast(kind).alias("key"), "text", F.col("before").alias("part"), F.lit(True).alias("is_next"))
    dealt = dealt.withColumn("is_next", F.lit(False)).union(heads)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        done: list[tuple] = []

        def line(row: tuple, next_text: str, next_sig: np.ndarray) -> tuple:
            k, body, sig = row
            other = edited(body, next_text)
            other_sig = signature(other, s)
            return (k, len(body), hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest(), fingerprint_hex(sig), fingerprint_hex(other_sig), likeness(sig, other_sig), likeness(sig, next_sig))

        def out(done: list[tuple]) -> pa.RecordBatch:
            kinds = (arrow, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], ["key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        for batch in slices(batches):
            for k, body, is_next in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                sig = signature(body, s)
                if held is not None:
                    done.append(line(held, body, sig))
                held = None if is_next else (k, body, sig)  # the next part's first row ends a part
            if len(done) >= 1000:
                yield out(done)
                done = []
        if done:
            yield out(done)

    ordered = dealt.repartitionById(max([*there, 0]) + 1, F.col("part")).sortWithinPartitions("part", "is_next", F.desc_nulls_last("key"), "text")
    return ordered.mapInArrow(run, f"key {kind.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document beside its edited text and the next document, in descending order of id; null texts count as empty."""
    return compare_neighbours(documents(spark, sf_dir), "doc_id", "text").withColumnRenamed("key", "doc_id")
