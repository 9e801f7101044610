"""Whole sets of word shingles, and the confirmation of pairs on them, dealt over tasks by chunks of a hot set's partners."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm._common import ASCII_LOWER, materialise, slices, text_bytes
from quire.llm.components import components

SHINGLE, SEED = 5, 42
#: Texts to read up to which their keys go to every task (some 100 bytes each); bytes of a group's sets that a task holds.
BROADCAST_TEXTS, GROUP_BYTES = 200_000, 64_000_000


def shingles(text: bytes, n: int = SHINGLE) -> np.ndarray:
    """XXH64 of the word shingles in order. Words are as in SimHash; fewer than n words make one shingle, none make none."""
    words = text.translate(ASCII_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= n:
        return np.array([digest(joined, SEED)], np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size)[: len(words) - n + 1].tolist()
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[n - 1 :].tolist(), strict=True)), np.uint64, len(starts))


def mark(text: str) -> Column:
    """A text's hash; null counts as empty."""
    return F.xxhash64(text_bytes(f"`{text}`"))


def linked(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    """Whether two sorted distinct arrays overlap enough."""
    both = len(np.intersect1d(p, q, assume_unique=True))
    return 100 * both >= percent * (len(p) + len(q) - both)


def dealt(rows: DataFrame, payload: str, check: Callable[[list, list, list, list], list[bool]]) -> DataFrame:
    """Pairs (a, b) of leaders and members that pass. rows: (node, fp, root, leads, chunks, payload): what leads also is a member.

    Members are dealt over chunks of their node and leaders go to each of them, sorted first. A task keeps one chunk's leaders and
    streams past them. check(leaders' payloads, leaders' roots, a slice of members' payloads, their roots) gives (leader, member) places.
    """
    members = rows.select("node", F.pmod(F.xxhash64("fp"), F.col("chunks")).alias("chunk"), F.lit(1).alias("kind"), "fp", "root", payload)
    leaders = rows.where("leads").select("node", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("kind"), "fp", "root", payload)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, lead = None, ([], [], [])
        for batch in slices(batches, column=payload):
            found: set[tuple[int, int]] = set()
            columns = [batch.column(i).to_pylist() for i in range(6)]
            edges = [i for i in range(batch.num_rows) if not i or columns[0][i] != columns[0][i - 1] or columns[1][i] != columns[1][i - 1] or columns[2][i] != columns[2][i - 1]]
            for i, j in zip(edges, [*edges[1:], batch.num_rows], strict=True):
                fps, roots, data = (c[i:j] for c in columns[3:])
                if (columns[0][i], columns[1][i]) != at:
                    at, lead = (columns[0][i], columns[1][i]), ([], [], [])
                if columns[2][i] == 0:
                    for held, new in zip(lead, (fps, roots, data), strict=True):
                        held.extend(new)
                elif lead[0]:
                    found.update((min(lead[0][p], fps[q]), max(lead[0][p], fps[q])) for p, q in check(lead[2], lead[1], data, roots))
            pairs = np.array(sorted(found), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return members.union(leaders).repartition("node", "chunk").sortWithinPartitions("node", "chunk", "kind").mapInArrow(meet, "a long, b long")


def _confirming(percent: int) -> Callable:
    def check(lead: list, _: list, data: list, __: list) -> list[tuple[int, int]]:
        p = np.frombuffer(lead[0], "<u8")
        return [(0, i) for i, q in enumerate(data) if linked(p, np.frombuffer(q, "<u8"), percent)]

    return check


class Confirmed:
    """Links found so far, whole sets of those that needed them, and the pairs that were looked at, as written tables."""

    def __init__(self, df: DataFrame, key: str, text: str, sets: DataFrame, percent: int) -> None:
        self.texts = df.select(F.col(f"`{key}`").alias("key"), mark(text).alias("mark"), text_bytes(f"`{text}`").alias("text"))
        self.at = sets.where("fp IS NOT NULL").groupBy("fp").agg(F.min(F.struct("key", "mark")).alias("x")).select("fp", "x.key", "x.mark")
        self.percent, self.whole, self.seen, self.links = percent, None, None, None

    def _data(self, wanted: DataFrame) -> DataFrame:
        """(fp, data): whole sets of fingerprints, from one text each. A repeated row gives its set once a task."""

        def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[int] = set()
            for batch in slices(batches):
                new = [i for i, fp in enumerate(batch.column(0).to_pylist()) if not (fp in seen or seen.add(fp))]
                rows = batch.take(pa.array(new, pa.int64()))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([np.unique(shingles(t)).tobytes() for t in rows.column(1).to_pylist()], pa.binary())], ["fp", "data"])

        at = materialise(self.at.join(wanted, "fp").select("fp", F.col("key").alias("k"), F.col("mark").alias("m")), "wanted")
        few = at.count() <= BROADCAST_TEXTS
        found = self.texts.join(F.broadcast(at) if few else at, self.texts.key.eqNullSafe(F.col("k")) & (self.texts.mark == F.col("m"))).select("fp", "text")
        return materialise(found.mapInArrow(compute, "fp long, data binary"), "whole-sets")

    def links_of(self, pairs: DataFrame) -> DataFrame:
        """A written table of those pairs (a, b) that overlap enough. Each end is a fingerprint and a the lesser; node and chunk, where given, name the group in which a pair was met.

        A set's text is read once for all calls. Pairs of one group share its sets, each of which then goes to one task once; groups
        whose sets are large, and pairs without one, are dealt by their lesser end.
        """
        wanted = pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct()
        if self.whole is not None:
            wanted = wanted.join(self.whole.select("fp"), "fp", "left_anti")
        new = self._data(wanted)
        self.whole = new if self.whole is None else self.whole.union(new)
        if "node" not in pairs.columns:
            return materialise(self._by_lesser(pairs), "links")
        ends = pairs.select("node", "chunk", F.explode(F.array("a", "b")).alias("fp")).distinct()
        sizes = ends.join(self.whole.select("fp", F.octet_length("data").alias("bytes")), "fp").groupBy("node", "chunk").agg(F.sum("bytes").alias("bytes"))
        light = sizes.where(F.col("bytes") <= GROUP_BYTES).select("node", "chunk")
        heavy = pairs.join(light, ["node", "chunk"], "left_anti")
        none = F.lit(None).cast("long")
        sets = ends.join(light, ["node", "chunk"], "left_semi").join(self.whole, "fp").select("node", "chunk", F.lit(0).alias("kind"), F.col("fp").alias("a"), none.alias("b"), "data")
        asked = pairs.join(light, ["node", "chunk"], "left_semi").select("node", "chunk", F.lit(1).alias("kind"), "a", "b", F.lit(None).cast("binary").alias("data"))
        percent = self.percent

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, held = None, {}
            for batch in batches:
                good = []
                for node, chunk, kind, x, y, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if (node, chunk) != at:
                        at, held = (node, chunk), {}
                    if kind == 0:
                        held[x] = np.frombuffer(data, "<u8")
                    elif linked(held[x], held[y], percent):
                        good.append((x, y))
                found = np.array(good, np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

        met = sets.union(asked).repartition("node", "chunk").sortWithinPartitions("node", "chunk", "kind").mapInArrow(check, "a long, b long")
        return materialise(met.union(self._by_lesser(heavy)), "links")

    def _by_lesser(self, pairs: DataFrame) -> DataFrame:
        many = pairs.groupBy(F.col("a").alias("node")).agg(F.ceil(F.count(F.lit(1)) / 64).alias("chunks"))
        ends = pairs.select(F.col("a").alias("node"), F.col("b").alias("fp"), F.lit(False).alias("leads")).union(many.select("node", F.col("node").alias("fp"), F.lit(True)))
        rows = ends.join(many, "node").join(self.whole, "fp").select("node", "fp", F.lit(0).alias("root"), "leads", "chunks", "data")
        return dealt(rows, "data", _confirming(self.percent)).where("a <> b")

    def add(self, pairs: DataFrame) -> DataFrame | None:
        """Confirm pairs (a, b, node, chunk) and return the components (node, root) of all links so far, or None if these are as they were."""
        pairs = pairs.groupBy("a", "b").agg(F.min(F.struct("node", "chunk")).alias("g")).select("a", "b", "g.*")
        if self.seen is not None:
            pairs = pairs.join(self.seen.select("a", "b"), ["a", "b"], "left_anti")
        pairs = materialise(pairs, "pairs")
        self.seen = pairs if self.seen is None else self.seen.union(pairs)
        good = self.links_of(pairs)
        self.links = good if self.links is None else self.links.union(good)
        return materialise(components(self.links), "joined") if good.limit(1).count() else None
