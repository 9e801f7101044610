"""Vector best-fit packing of token pieces into sequences under token, document and attention capacities.

A piece's demand is a vector (tokens, 1 document, tokens squared for attention), so pieces of one length are
alike. The packer therefore works on the histogram of lengths, which is bounded by the capacity and not by
the data: it places all pieces of a length at once, longest first, into classes of bins with the same
residual vector. What it returns are runs "pieces rank a to b of this length go to sequences from s on, at
offset o", and every piece then finds its place from its length and its rank among its like.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm._common import documents, materialise, slices
from quire.llm.encoding import WORD_BPE, encoder, tokenizer_path

#: Pre-tokens whose ids a worker keeps, about 300 bytes each. With 80,000, encoding of varied text takes 1.6 times as long.
MEMO = 600_000


@dataclass(frozen=True)
class Capacity:
    """tokens: of a sequence. documents, attention: of a sequence; the defaults bind no sequence that tokens doesn't.

    weights: of the residual tokens, documents and attention, each as a share of its capacity.
    rule: "norm" takes the bin with the least weighted residual norm after placing, "dot" the one whose residual
    has the largest weighted dot product with the demand.
    """

    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05)
    rule: str = "norm"


def best_fit(histogram: dict[int, int], cap: Capacity) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, pieces, first sequence, offset, position in the sequence's order of placing).

    Rank r of the run goes to sequence first + r - first rank, at the offset. Bins of a class are numbered
    without gaps, so a run is a range in both. A length over the token capacity, or a piece that fits no empty
    bin, is an error. Zero lengths are placed like others.
    """
    if any(n > cap.tokens or n * n > cap.attention for n in histogram) or cap.documents < 1:
        raise ValueError("a piece is larger than a sequence")
    scale = np.array([cap.tokens, cap.documents, cap.attention], float)
    w = np.array(cap.weights, float)
    #: A class: residual (tokens, documents, attention) to ranges of sequences (first, count).
    classes: dict[tuple[int, int, int], list[tuple[int, int]]] = {}
    runs, sequences = [], 0
    for length in sorted((n for n in histogram if histogram[n] > 0), reverse=True):
        left, rank = histogram[length], 0
        need = np.array([length, 1, length * length], float)
        while left:
            states = np.array(list(classes), float).reshape(-1, 3)
            fits = (states >= need).all(axis=1) if len(states) else np.zeros(0, bool)
            if fits.any():
                open_ = states[fits]
                value = np.linalg.norm((open_ - need) / scale * w, axis=1) if cap.rule == "norm" else -((open_ / scale) * (need / scale) * w).sum(axis=1)
                state = tuple(int(x) for x in open_[int(np.argmin(value))])
                ranges = classes.pop(state)
            else:
                state, each = (cap.tokens, cap.documents, cap.attention), min(cap.tokens // max(length, 1), cap.documents, cap.attention // max(length * length, 1))
                ranges = [(sequences, -(-left // max(1, each)))]
                sequences += ranges[0][1]
            # A bin takes pieces of this length until the next doesn't fit; the last may take fewer.
            each = min(state[0] // length if length else left, state[1], state[2] // (length * length) if length else left)
            while ranges and left:
                first, count = ranges.pop()
                full, some = min(count, left // each), 0
                if full < count and left - full * each:
                    some = left - full * each
                for took, n, at in ((each, full, first), (some, 1 if some else 0, first + full)):
                    for j in range(took if n else 0):
                        runs.append((length, rank, n, at, cap.tokens - state[0] + j * length, cap.documents - state[1] + j))
                        rank += n
                        left -= n
                    if n:
                        classes.setdefault((state[0] - took * length, state[1] - took, state[2] - took * length * length), []).append((at, n))
                used = full + (1 if some else 0)
                if used < count:
                    ranges.append((first + used, count - used))
            if ranges:
                classes.setdefault(state, []).extend(ranges)
    return runs


def pieces(df: DataFrame, key: str, text: str, vocabulary: str, tokens: int, end_id: int = 0, memo: int = MEMO) -> DataFrame:
    """Encode the texts and cut the longer ones: one row for each piece, with its rank among the pieces of its length in its task.

    Null texts count as empty (one piece of the end id). Other columns of df aren't carried. memo: pre-tokens whose ids a worker keeps.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seen = encoder(vocabulary, memo), TaskContext.get().partitionId(), [0] * (tokens + 1)
        end = np.array([end_id], "<u4").tobytes()
        for batch in slices(batches):
            rows: list[tuple] = []
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = enc.encode_bytes(body) + end
                for i, at in enumerate(range(0, len(got), 4 * tokens)):
                    ids = got[at : at + 4 * tokens]
                    n = len(ids) // 4
                    rows.append((doc, i, at // 4, n, zlib.crc32(ids), part, seen[n]))
                    seen[n] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (key_type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    from pyspark.sql.pandas.types import to_arrow_type

    key_type = to_arrow_type(df.schema[key].dataType)
    return df.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(cut, f"doc_id {df.schema[key].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, part int, nth long")


def pack(cut: DataFrame, cap: Capacity) -> DataFrame:
    """Give each piece (length, part, nth of a materialised table) its sequence_id and offset.

    Pieces of equal length are alike, so ties are settled by their ranks; repeated rows are pieces of their own, and an
    empty table gives an empty one.

    Ranks come from prefix sums over the pieces of a length in each part. Only the histogram of lengths (at most
    cap.tokens rows) reaches the driver, and only the runs, whose number depends on the distinct lengths, go back.
    """
    spark = cut.sparkSession
    counts = cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = materialise(counts.select("length", "part", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "packing-bases")
    histogram = {r["length"]: r["n"] for r in bases.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = np.array(sorted(best_fit(histogram, cap)), np.int64).reshape(-1, 6)
    shared = spark.sparkContext.broadcast(runs)
    columns = [f.name for f in cut.schema if f.name not in ("part", "nth")]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = shared.value
        order = runs[:, 0] * (1 << 40) + runs[:, 1]  # a length and a rank under 2**40, as one sortable number
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(order, length * (1 << 40) + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in columns), pa.array(runs[at, 3] + rank - runs[at, 1]), pa.array(runs[at, 4])], [*columns, "sequence_id", "offset"])

    # Bases are lengths x parts, so they grow with the input: both sides meet by a shuffle, never by a broadcast.
    ranked = cut.join(bases.drop("n").hint("merge"), ["length", "part"]).withColumn("rank", F.col("nth") + F.col("base")).drop("part", "nth", "base")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema if f.name in columns)
    return ranked.mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def op7_vector_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of 2048 tokens; null texts are a piece of the end id, repeated rows are pieces of their own."""
    return pack_documents(documents(spark, sf_dir), Capacity())


def pack_documents(docs: DataFrame, cap: Capacity, vocabulary: str | None = None, memo: int = MEMO) -> DataFrame:
    cut = materialise(pieces(docs, "doc_id", "text", vocabulary or tokenizer_path(WORD_BPE), cap.tokens, memo=memo), "packing-pieces")
    return pack(cut, cap)
