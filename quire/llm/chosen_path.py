"""Set similarity join by chosen paths: connected classes of texts whose shingle sets overlap by at least a stated share.

Every distinct set has a signature of 128 minwise tokens. A tree's root sends each set to the node named by one of its tokens; a node
that is too large sends its sets on to children named by further tokens, chosen anew by the node's path, so that sets stay
together with a probability of about their similarity at each step. Nodes with few sets are compared exhaustively, and independent trees
repeat all that. Two sets at the threshold of 0.85 miss each other's company with probability 0.18 in a tree (one token at the
root, two at each later node), so with 8 trees in about one case of a million.

Only links matter that join what isn't joined yet. At each level the sets of a node that aren't in its largest component so far first
offer the pair with the set that they are most like, and the confirmed pairs join a group of near copies however large; in the nodes
that still hold several components each set outside the largest then meets all others. A node is small if few sets are outside
it, whatever its size. A node of alike sets that further tokens don't part is compared at once, in blocks. Comparing is dealt over
chunks of a node and blocks of those outside, so no task gets a whole hot node. Sketches of two bits a token decide which pairs are
worth confirming on the whole sets, of those that parities don't rule out: the bits at which two sets' parities of shingles in 2048 bins
differ are never more than the shingles that one of them lacks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm._common import documents, materialise, slices, text_bytes
from quire.llm.confirm import Confirmed, mark, shingles

#: Two sets are linked if 100 times their intersection is at least 85 times their union.
PERCENT = 85
TREES, FAN, TOKENS, BINS = 8, 2, 256, 2048
#: Sets outside a node's largest component up to which it is compared exhaustively; members of a node in a task at most (about).
SMALL, CHUNK = 8192, 8192
#: How often a level's sets offer their best pairs, if each time links come of it, before all pairs meet.
OFFERS = 2
#: Equal sketch tokens of 256 that a pair needs to be confirmed: 3.6 standard deviations under what is expected at 0.85, 4.6 at 0.87.
AGREE = 209
#: A node has (sets outside) x (sets) pairs to compare. It is compared, in blocks of SMALL, if its FAN children are likely to have more
#: than this share of them, going by what itself has of its parent's; and at the deepest level whatever its size.
WORTH, DEEPEST = 0.9, 24
_FACTORS = np.random.default_rng(13).integers(1 << 62, 1 << 63, TOKENS, dtype=np.uint64) | np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def signature(data: np.ndarray, trees: int = TREES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """256 minwise tokens of 16 bits; a sketch: the first bits of all, then the second ones, then the parities of the shingles in each bin; and the trees' first tokens in full, which sets don't share by chance."""
    least = np.full(TOKENS, np.uint64(2**64 - 1))
    for at in range(0, len(data), 512):
        np.minimum(least, (data[at : at + 512, None] * _FACTORS).min(axis=0), out=least)
    tokens = (least * _MIX) >> np.uint64(46)
    odd = np.bincount((data * _MIX >> np.uint64(53)).astype(np.int64), minlength=BINS) & 1
    sketch = np.concatenate([np.packbits([tokens & np.uint64(1), tokens >> np.uint64(1) & np.uint64(1)], axis=1).ravel(), np.packbits(odd.astype(np.uint8))])
    return (tokens >> np.uint64(2)).astype("<u2"), sketch, least[: TOKENS // trees * trees : TOKENS // trees].astype("<u8")


def agreeing(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """How many tokens sketches p agree on with sketches q, each a row of words whose first 8 are the tokens' bits."""
    apart = np.zeros((len(p), len(q)), np.int16)
    for w in range(4):
        apart += np.bitwise_count((p[:, w, None] ^ q[None, :, w]) | (p[:, 4 + w, None] ^ q[None, :, 4 + w]))
    return TOKENS - apart


def beyond(p: np.ndarray, q: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of sketches (p[i], q[i]) can't be of linked sets, sizes being the two sets' together. Never true of linked ones."""
    out = np.zeros(len(p), bool)
    for at in range(0, len(p), 20_000):
        some = slice(at, at + 20_000)
        lacking = np.bitwise_count(p[some, 8:] ^ q[some, 8:]).sum(axis=1, dtype=np.int64)
        out[some] = (100 + percent) * lacking > (100 - percent) * sizes[some]
    return out


def _sets(df: DataFrame, key: str, text: str, trees: int) -> DataFrame:
    """A written table (key, mark, fp, n, tokens, sketch, heads): fp names the set; a task gives a set's signature once, its further copies have null; empty sets have no fp."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = df.schema[key].dataType
    arrow = to_arrow_type(kind)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches):
            fps, sizes, tokens, sketches, heads = [], [], [], [], []
            for t in batch.column(2).to_pylist():
                data = np.unique(shingles(t))
                sizes.append(len(data))
                fp = xxhash.xxh64_intdigest(data.tobytes(), 13) if len(data) else None
                fps.append(None if fp is None else fp - (fp >> 63 << 64))
                new = signature(data, trees) if fp is not None and fp not in seen else None
                tokens.append(new and new[0].tobytes())
                sketches.append(new and new[1].tobytes())
                heads.append(new and new[2].tobytes())
                seen.add(fp)
            if len(seen) > 1_000_000:
                seen.clear()
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(arrow), batch.column(1), pa.array(fps, pa.int64()), pa.array(sizes, pa.int64()), *(pa.array(x, pa.binary()) for x in (tokens, sketches, heads))], ["key", "mark", "fp", "n", "tokens", "sketch", "heads"])

    rows = df.select(F.col(f"`{key}`").alias("key"), mark(text).alias("mark"), text_bytes(f"`{text}`").alias("text"))
    return materialise(rows.mapInArrow(compute, f"key {kind.simpleString()}, mark long, fp long, n long, tokens binary, sketch binary, heads binary"), "sets")


class _Chunk:
    """One chunk of a node as it streams in: leaders first, then members."""

    def __init__(self, alone: bool, most: int, best: bool, percent: int) -> None:
        self.alone, self.most, self.best, self.percent, self.lead, self.members = alone, most, best, percent, ([], [], [], []), False

    def add(self, leads: bool, *rows: list) -> Iterator[tuple[int, int]]:
        if leads:
            for held, new in zip(self.lead, rows, strict=True):
                held.extend(new)
        else:
            yield from self._begin()
            yield from self._compare(*rows)

    def _begin(self) -> Iterator[tuple[int, int]]:
        if not self.members:
            self.members = True
            self.fps, self.roots, self.sketches = np.array(self.lead[0], np.int64), np.array(self.lead[1], np.int64), np.frombuffer(b"".join(self.lead[2]), "<u8").reshape(-1, 8 + BINS // 64)
            self.sizes = np.array(self.lead[3], np.int64)
            self.top = np.full(len(self.fps), self.most - 1, np.int16), np.zeros(len(self.fps), np.int64)
            if self.alone:  # leaders aren't dealt again as members
                yield from self._compare(*self.lead)

    def _compare(self, fps: list, roots: list, sketches: list, sizes: list) -> Iterator[tuple[int, int]]:
        if not len(self.fps):
            return
        q, f, r, n = np.frombuffer(b"".join(sketches), "<u8").reshape(-1, 8 + BINS // 64), np.array(fps, np.int64), np.array(roots, np.int64), np.array(sizes, np.int64)
        step = max(1, 500_000 // len(self.fps))  # some megabytes of comparisons at once
        for i in range(0, len(f), step):
            agree = agreeing(self.sketches, q[i : i + step])
            own, other = self.sizes[:, None], n[None, i : i + step]  # sizes alone rule out some
            agree[(self.roots[:, None] == r[None, i : i + step]) | (100 * np.minimum(own, other) < self.percent * np.maximum(own, other))] = -1
            x, y = np.nonzero(agree >= self.most)
            out = beyond(self.sketches[x], q[i + y], self.sizes[x] + n[i + y], self.percent)
            agree[x[out], y[out]] = -1
            if self.best:
                at = agree.argmax(axis=1)
                value = agree[np.arange(len(at)), at]
                better = value > self.top[0]
                self.top[0][better], self.top[1][better] = value[better], f[i + at[better]]
            else:
                yield from zip(self.fps[x[~out]].tolist(), f[i + y[~out]].tolist(), strict=True)

    def end(self) -> Iterator[tuple[int, int]]:
        yield from self._begin()
        if self.best:
            good = self.top[0] >= self.most
            yield from zip(self.fps[good].tolist(), self.top[1][good].tolist(), strict=True)


def _alike(rows: DataFrame, most: int, best: bool, percent: int) -> DataFrame:
    """Pairs (a, b, node, chunk) of rows (node, fp, root, leads, chunks, sketch, n) of one node and different components, one of which leads, that agree on most tokens.

    best: of each leader only the best in each chunk. Members are dealt over chunks of their node and leaders go to each.
    """
    alone = F.col("chunks") == 1
    members = rows.select("node", F.pmod(F.xxhash64("fp"), F.col("chunks")).alias("chunk"), F.when(alone & F.col("leads"), 0).otherwise(1).alias("kind"), alone.alias("alone"), "fp", "root", "sketch", "n")
    leaders = rows.where(F.col("leads") & ~alone).select("node", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("kind"), F.lit(False).alias("alone"), "fp", "root", "sketch", "n")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, chunk = None, None
        for batch in batches:
            found: set[tuple[int, int, int, int]] = set()
            columns = [c.to_pylist() for c in batch.columns]
            heads = list(zip(*columns[:3], strict=True))
            edges = [i for i in range(len(heads)) if not i or heads[i] != heads[i - 1]]
            for i, j in zip(edges, [*edges[1:], len(heads)], strict=True):
                if heads[i][:2] != at:
                    if chunk:
                        found.update((*p, *at) for p in chunk.end())
                    at, chunk = heads[i][:2], _Chunk(columns[3][i], most, best, percent)
                found.update((*p, *at) for p in chunk.add(heads[i][2] == 0, *(c[i:j] for c in columns[4:])))
            yield _pairs(found)
        if chunk:
            yield _pairs({(*p, *at) for p in chunk.end()})

    return members.union(leaders).repartition("node", "chunk").sortWithinPartitions("node", "chunk", "kind").mapInArrow(meet, "a long, b long, node long, chunk long")


def _pairs(found: set[tuple[int, int, int, int]]) -> pa.RecordBatch:
    rows = np.array(list(found), np.int64).reshape(-1, 4)
    rows[:, :2].sort(axis=1)
    return pa.RecordBatch.from_arrays([pa.array(rows[:, i].copy()) for i in range(4)], ["a", "b", "node", "chunk"])


def _told(rows: DataFrame, joined: DataFrame | None) -> DataFrame:
    """rows (node, fp, before) with each set's component so far, of nodes that hold several; outside: how many sets aren't of the node's largest."""
    if joined is None:
        rooted = rows.withColumn("root", F.col("fp"))
    else:
        rooted = rows.join(joined.select(F.col("node").alias("f"), F.col("root").alias("r")), F.col("fp") == F.col("f"), "left").select("node", "fp", "before", F.coalesce("r", "fp").alias("root"))
    by = rooted.groupBy("node", "root").agg(F.count(F.lit(1)).alias("n"))
    nodes = by.groupBy("node").agg(F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("top"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    nodes = nodes.select("node", "n", (F.col("n") - F.col("top.n")).alias("outside"), F.col("top.root").alias("top"), F.ceil(F.col("n") / CHUNK).alias("chunks"))
    # pairs to compare here; before has those of the parent
    return materialise(rooted.join(nodes, "node").withColumn("pairs", F.col("outside").cast("double") * F.col("n")), "nodes")


def classes(df: DataFrame, key: str, text: str, percent: int = PERCENT, trees: int = TREES, small: int = SMALL, agree: int = AGREE, deepest: int = DEEPEST) -> DataFrame:
    """(key, n, component) for every row: the size of its text's set of five-word shingles and the smallest key that links reach, its own included.

    agree goes with percent: tokens that two signatures must share for a pair to be confirmed. Null and empty texts and texts of
    white space have empty sets, linked with nothing: each row is a component of its own. Repeated rows and equal texts are linked, by one set.
    Null keys name no component but where a class has no other. An empty table gives an empty one.
    """
    sets = _sets(df, key, text, trees)
    sigs = materialise(sets.where("sketch IS NOT NULL").groupBy("fp").agg(F.first("tokens").alias("tokens"), F.first("sketch").alias("sketch"), F.first("heads").alias("heads"), F.first("n").alias("n")), "signatures")
    sketches = sigs.select("fp", "sketch", F.col("n").alias("size"))
    alike = lambda rows, best: _alike(rows.join(sketches, "fp").select("node", "fp", "root", "leads", "chunks", "sketch", F.col("size").alias("n")), agree, best, percent)
    confirmed = Confirmed(df, key, text, sets, percent)
    token = lambda i: F.substring("tokens", 2 * i + 1, 2)
    start = F.explode(F.array(*[F.xxhash64(F.lit(t), F.substring("heads", 8 * t + 1, 8)) for t in range(trees)]))
    rows = materialise(sigs.select(start.alias("node"), "fp", F.lit(None).cast("double").alias("before")), "level")
    joined, depth = None, 0
    while True:
        depth += 1
        last = F.lit(depth >= deepest)
        stops = (F.col("outside") <= small) | last | (FAN * F.col("pairs") > WORTH * F.coalesce("before", F.lit(float("inf"))))
        told = _told(rows, joined)
        for _ in range(OFFERS):
            # sets offer their best pair: in small nodes all that are outside, in others each in a chunk of its own kind
            some = told.where(F.col("outside") <= small).select("node", "fp", "root", (F.col("root") != F.col("top")).alias("leads"), "chunks")
            local = told.where(F.col("outside") > small).select(F.xxhash64("node", F.pmod(F.xxhash64("fp", F.lit(2)), F.ceil(F.col("n") / SMALL))).alias("node"), "fp", "root", F.lit(True).alias("leads"), F.lit(1).cast("long").alias("chunks"))
            more = confirmed.add(alike(some.union(local), True))
            if more is None:
                break
            joined = more
            told = _told(told.select("node", "fp", "before"), joined)
        blocks = F.ceil(F.col("outside") / small)
        led = told.where(stops).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
        led = led.withColumn("leads", (F.col("root") != F.col("top")) & (F.pmod(F.xxhash64("fp", F.lit(1)), blocks) == F.col("block"))).withColumn("node", F.xxhash64("node", "block"))
        joined = confirmed.add(alike(led, False)) or joined
        child = lambda f: F.xxhash64("node", F.lit(f), token(F.pmod(F.xxhash64("node", F.lit(f), F.lit(depth)), F.lit(TOKENS)).cast("int")))  # noqa: E731, B023
        rows = materialise(told.where(~stops).join(sigs.select("fp", "tokens"), "fp").select(F.explode(F.array(*[child(f) for f in range(FAN)])).alias("node"), "fp", F.col("pairs").alias("before")), "level")
        if not rows.limit(1).count():
            break
    own = sets.where("fp IS NOT NULL").groupBy("fp").agg(F.min("key").alias("least"))
    if joined is None:
        of = own.select("fp", F.col("least").alias("component"))
    else:
        rooted = materialise(own.join(joined, own.fp == joined.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "classes")
        of = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component")), "root").select("fp", "component")
    return sets.select("key", "fp", "n").join(of, "fp", "left").select("key", "n", F.when(F.col("fp").isNull(), F.col("key")).otherwise(F.col("component")).alias("component"))


def op13_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class at 85 % of its five-word shingles; see classes() for nulls, empty texts and repeated rows."""
    out = classes(documents(spark, sf_dir), "doc_id", "text")
    same: Column = F.col("key").eqNullSafe(F.col("component"))
    return out.select(F.col("key").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), same.alias("kept"))
