"""SimHash fingerprints of word shingles, linked through Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits, each read as a 23-bit word. Two
fingerprints at up to 4 differing bits either agree on a whole segment, or have errors in all three
(1+1+1 or 1+1+2) and so two segments with one error each. The first case meets under the segment's value. For
the second, a segment is decoded by the perfect Golay code [23, 12, 7]: its nearest codeword's 12-bit index
is an index key, and the indices of all codewords that are nearest to it or to a word one bit away are its
probes (one, or six where the nearest codeword is three bits away). One fingerprint's index key is then among
the other's probes. Two segments' indices together make 24-bit keys. Pairs that meet are verified by their
differing bits, so the links are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm._common import ASCII_LOWER, documents, materialise, slices, text_bytes
from quire.llm.components import components
from quire.llm.confirm import mark
from quire.llm.shingle_join import groups

SHINGLE, SEED, DISTANCE = 4, 42, 4
_SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit, bits
_PAIRS = ((0, 1), (0, 2), (1, 2))
#: Fixed value: generator polynomial of the binary Golay code.
_GENERATOR = 0b110001110101


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator."""
    rest = words.astype(np.int64).copy()
    for bit in range(22, 10, -1):
        rest ^= np.where(rest >> bit & 1, _GENERATOR << (bit - 11), 0)
    return rest


def _decoder() -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome: the error of at most 3 bits, and the errors of 4 bits where the former has 3 (else -1)."""
    near, far = np.zeros(2048, np.int64), np.full((2048, 5), -1, np.int64)
    filled = np.zeros(2048, np.int64)
    for n in range(5):
        errors = np.array([sum(1 << b for b in c) for c in combinations(range(23), n)], np.int64)
        of = _syndromes(errors)
        if n < 4:
            near[of] = errors
        else:
            for e, s in zip(errors.tolist(), of.tolist(), strict=True):
                if near[s].bit_count() == 3:
                    far[s, filled[s]] = e
                    filled[s] += 1
    return near, far


_NEAR, _FAR = _decoder()


def golay_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For 23-bit words: the nearest codeword's index, and the 6 probes (the first is the nearest; -1 where there are none)."""
    of = _syndromes(words)
    nearest = (words ^ _NEAR[of]) >> 11
    more = np.where(_FAR[of] >= 0, (words[:, None] ^ _FAR[of]) >> 11, -1)
    return nearest, np.concatenate([nearest[:, None], more], axis=1)


def fingerprint(text: bytes, n: int = SHINGLE, seed: int = SEED) -> int:
    """A bit is 1 if it is set in over half the shingles' XXH64; repeated shingles count as often as they occur.

    Words are runs of other than ASCII white space after lower-casing A-Z. Fewer than n words make one shingle; none make 0.
    """
    words = text.translate(ASCII_LOWER).split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= n:
        return digest(joined, seed)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size)[: len(words) - n + 1].tolist()
    ends = ends[n - 1 :].tolist()
    total, counts = len(starts), np.zeros(64, np.int64)
    for at in range(0, total, 65_536):  # flat memory for very long texts
        h = np.array([digest(joined[a:b], seed) for a, b in zip(starts[at : at + 65_536], ends[at : at + 65_536], strict=True)], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, key: str, text: str, n: int = SHINGLE) -> DataFrame:
    """(key, fp): the fingerprint of every row as a signed 64-bit integer. Null texts count as empty."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = df.schema[key].dataType
    arrow = to_arrow_type(kind)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.array([fingerprint(t, n) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(arrow), pa.array(found)], ["key", "fp"])

    return df.select(F.col(key).alias("key"), text_bytes(text).alias("text")).mapInArrow(compute, f"key {kind.simpleString()}, fp long")


def _segments(fp: np.ndarray) -> list[np.ndarray]:
    u = fp.view(np.uint64)
    return [((u >> np.uint64(at)) & np.uint64((1 << bits) - 1)).astype(np.int64) for at, bits in _SEGMENTS]


def _index_keys(fp: np.ndarray) -> list[np.ndarray]:
    near = [golay_keys(s)[0] for s in _segments(fp)]
    return [(p << 24) | (near[i] << 12) | near[j] for p, (i, j) in enumerate(_PAIRS)]


def _bitmap(fps: DataFrame) -> np.ndarray:
    """Which of the 3 x 2**24 index keys occur, as bits: 6 MB however many fingerprints there are."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(3 << 24 >> 3, np.uint8)
        for batch in batches:
            for keys in _index_keys(batch.column(0).to_numpy()):
                np.bitwise_or.at(bits, keys >> 3, (1 << (keys & 7)).astype(np.uint8))
        at = np.nonzero(bits.view("<i8"))[0]
        for i in range(0, len(at), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[i : i + 100_000]), pa.array(bits.view("<i8")[at[i : i + 100_000]])], ["at", "bits"])

    found = fps.mapInArrow(words, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toPandas()
    out = np.zeros(3 << 24 >> 6, np.int64)
    out[found["at"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return out.view(np.uint8)


#: A group under one key beyond this size is cut by further bits of its fingerprints.
DENSE = 4096


def _free_blocks(kind: int, most: int) -> list[tuple[int, int]]:
    """(first bit, bits) of blocks, one of which is equal in any two fingerprints that need to meet under a key of the kind.

    Under a segment's value, errors are in the other bits: ``most`` of them, so one of most + 1 blocks has none. Under two
    segments' indices the third has most - 2 at most; pairs with a whole segment in common meet elsewhere.
    """
    if kind >= 3:
        spans, n = [s for i, s in enumerate(_SEGMENTS) if i != kind - 3], most + 1
    else:
        spans, n = [s for i, s in enumerate(_SEGMENTS) if i not in _PAIRS[kind]], max(most - 1, 1)
    bits = [b for first, size in spans for b in range(first, first + size)]
    edges = [len(bits) * i // n for i in range(n + 1)]
    out = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        some = bits[a:b]
        cut = next((i for i in range(1, len(some)) if some[i] != some[i - 1] + 1), len(some))
        out.append(max([(some[0], cut), (some[cut] if cut < len(some) else 0, len(some) - cut)], key=lambda x: x[1]))  # of a block over two spans the larger run
    return out


def _cut(fp: np.ndarray, kind: int, most: int) -> Iterator[np.ndarray]:
    """A dense group's links: its members are compared under each block's value, so 2**8 or so times fewer of them meet."""
    fp = np.unique(fp).view(np.uint64)
    for first, bits in _free_blocks(kind, most):
        block = fp >> np.uint64(first) & np.uint64((1 << bits) - 1)
        order = np.argsort(block, kind="stable")
        block = block[order]
        edges = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True])
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if b - a > 1:
                yield from _spanning(fp[order[a:b]].view(np.int64), most)


def _spanning(fp: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Links that join what is linked among fingerprints under one key, without all pairs of a dense group.

    Visits fingerprints in turn: each is compared with those not reached yet, and those within the distance are
    reached from it. A dense group is reached from its first member.
    """
    fp = np.unique(fp).view(np.uint64)
    left = np.ones(len(fp), bool)
    for start in range(len(fp)):
        if not left[start]:
            continue
        left[start] = False
        queue = [start]
        while queue:
            i = queue.pop()
            rest = np.nonzero(left)[0]
            if not len(rest):
                return
            near = rest[np.bitwise_count(fp[rest] ^ fp[i]) <= most]
            if len(near):
                left[near] = False
                queue.extend(near.tolist())
                yield np.stack([np.full(len(near), fp[i], np.uint64), fp[near]], axis=1)


def links(fps: DataFrame, most: int = DISTANCE) -> DataFrame:
    """fps: a written table of distinct fingerprints (fp). Returns links (a, b) that join all within the distance.

    Every two fingerprints at up to ``most`` differing bits (4 at most) end in one component of these links;
    each link is itself such a pair.
    """
    if not 0 <= most <= DISTANCE:
        raise ValueError("the keys hold for up to 4 differing bits")
    spark = fps.sparkSession
    present = spark.sparkContext.broadcast(_bitmap(fps))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = present.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                fp = batch.column(0)[at : at + 2000].to_numpy()
                parts = _segments(fp)
                probes = [golay_keys(s)[1] for s in parts]
                out = [((i + 3) << 24 | s, fp) for i, s in enumerate(parts)]
                out += [(k, fp) for k in _index_keys(fp)]
                for p, (i, j) in enumerate(_PAIRS):
                    a, b = probes[i][:, :, None], probes[j][:, None, :]
                    keys = (p << 24) | (a << 12) | b
                    row, *_ = np.nonzero(good := (a >= 0) & (b >= 0))
                    keys = keys[good]
                    used = (there[keys >> 3] >> (keys & 7).astype(np.uint8) & 1).astype(bool)
                    own = (probes[i][:, 0] << 12 | probes[j][:, 0] | p << 24)[row] == keys
                    out.append((keys[used & ~own], fp[row[used & ~own]]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([k for k, _ in out])), pa.array(np.concatenate([f for _, f in out]))], ["key", "fp"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_key, kept_fp = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in _with_end(batches):
            if batch is not None:
                kept_key = np.concatenate([kept_key, batch.column(0).to_numpy()])
                kept_fp = np.concatenate([kept_fp, batch.column(1).to_numpy()])
                if not len(kept_key):
                    continue
                upto = int(np.searchsorted(kept_key, kept_key[-1]))  # the last key may go on in the next batch
            else:
                upto = len(kept_key)
            key, fp = kept_key[:upto], kept_fp[:upto]
            kept_key, kept_fp = kept_key[upto:], kept_fp[upto:]
            found = list(_met(key, fp, most))
            if found:
                pairs = np.unique(np.sort(np.concatenate(found).view(np.int64), axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    rows = fps.mapInArrow(keyed, "key long, fp long")
    dealt = rows.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(meet, "a long, b long")


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _met(key: np.ndarray, fp: np.ndarray, most: int, dense: int = DENSE) -> Iterator[np.ndarray]:
    """Links under each key of sorted rows."""
    if not len(key):
        return
    edges = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
    starts, sizes = edges[:-1], np.diff(edges)
    for n in (2, 3):  # nearly all keys have few rows: compare those together
        some = starts[sizes == n]
        for i, j in combinations(range(n), 2):
            a, b = fp[some + i].view(np.uint64), fp[some + j].view(np.uint64)
            good = (np.bitwise_count(a ^ b) <= most) & (a != b)
            if good.any():
                yield np.stack([a[good], b[good]], axis=1)
    for s, n in zip(starts[sizes > 3].tolist(), sizes[sizes > 3].tolist(), strict=True):
        yield from _spanning(fp[s : s + n], most) if n <= dense else _cut(fp[s : s + n], int(key[s]) >> 24, most)


def classes(prints: DataFrame, most: int = DISTANCE) -> DataFrame:
    """prints: a written table (key, fp). Returns (key, fp, component): the smallest key that links reach, its own included.

    Equal fingerprints are one class from the start, so copies add no work. Null keys never name a component
    unless a class has no other, whose component is then null.
    """
    own = materialise(prints.groupBy("fp").agg(F.min("key").alias("least")), "fingerprints")
    joined = materialise(components(links(own.select("fp"), most)), "components")
    named = own.join(joined, own.fp == joined.node).groupBy("root").agg(F.min("least").alias("component"))
    linked = joined.join(named, "root").select(F.col("node").alias("fp"), "component")
    of = materialise(own.join(linked, "fp", "left").select("fp", F.coalesce("component", "least").alias("component")), "classes")
    return prints.join(of, "fp").select("key", "fp", "component")


def op10_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component; null and empty texts have fingerprint zero and are linked like any other."""
    prints = materialise(fingerprints(documents(spark, sf_dir), "doc_id", "text"), "prints")
    out = classes(prints)
    return out.select(F.col("key").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def _bits(hashes: np.ndarray) -> int:
    """The fingerprint of shingle hashes, repeats included."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        counts += np.unpackbits(hashes[at : at + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def near_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Keep one row of each group of near copies: that with the smallest key, of equal keys that whose text hashes lowest.

    Near copies have five-word shingles of Jaccard similarity 0.8 or more. They are met by Golay links of their fingerprints and,
    as those reach 4 bits only, by MinHash bands, and verified. Columns of docs stay as they are. Rows with one key but unlike
    texts are told apart by their texts, and each group keeps its own; of rows with equal key and text one stays. Null texts count
    as empty, and one of all empty ones stays. Rows with a null key have no name to be kept under, and all stay.
    """
    k = F.col(f"`{key}`")
    keyed = docs.where(k.isNotNull())
    alike = materialise(groups(keyed, key, text, _bits, links).groupBy("root", "key", "mark").agg(F.count(F.lit(1)).alias("n")), "alike")
    first = alike.groupBy("root").agg(F.min(F.struct("key", "mark")).alias("m")).select("root", F.col("m.key").alias("__k"), F.col("m.mark").alias("__m"))
    told = alike.join(first, "root").select(F.col("key").alias("__k0"), F.col("mark").alias("__m0"), ((F.col("key") == F.col("__k")) & (F.col("mark") == F.col("__m"))).alias("stays"), "n")
    gone = materialise(told.where("NOT stays OR n > 1"), "gone")  # fewer than what stays
    met = (k == F.col("__k0")) & (mark(text) == F.col("__m0"))
    out = keyed.join(gone, met, "left_anti")
    again = gone.where("stays")
    if again.limit(1).count():  # repeated rows, of which few reach the shuffle
        out = out.union(keyed.join(again, met).dropDuplicates(["__k0", "__m0"]).select(*[F.col(f"`{c}`") for c in docs.columns]))
    return out.union(docs.where(k.isNull()))
