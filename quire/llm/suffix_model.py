"""Probabilistic suffix tree over words, and add-one unigram scores, of whole texts.

A text is its words and an end symbol. The tree's symbols are training's words, the end, and, as in the base score,
one event for all words that training doesn't hold. Its contexts are the up to ``depth`` words before a symbol; they
don't reach beyond the text's start. A context is retained if its next-symbol distribution differs from its shorter
context's by more than the parameters it costs (a divergence test), with all its suffixes. Each state's distribution is
smoothed (Witten-Bell) through its shorter contexts down to the unigrams, whose share for unknown words is Good and
Turing's; so every state's probabilities, unknown words included, sum to one. The longest retained suffix scores a symbol.

Nothing of the tree stands in one place: contexts that end in one word are one task's, so a context, its suffixes and
all symbols it scores meet there, and further depth costs no further shuffle. A word with more than ``spread``
occurrences is dealt over several tasks by the word before it: its longer contexts are whole there, and what follows the
word alone is counted beforehand, over all tasks, so that the tree is the same wherever that bound lies. Equal texts of a
slice are scored once.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm._common import ASCII_LOWER, documents, materialise, new_path, residue, slices, text_bytes
from quire.llm.token_files import _filesystem

_SHORT = np.uint64(1 << 40)
_NONE = np.uint64((1 << 41) - 1)  # what stands before a text
_CODES = np.uint64(1 << 32)  # numbers below are head words' ranks, others are words' hashes
_ODD = np.uint64(0x9E3779B97F4A7C15)
_LN10 = math.log(10)


@dataclass(frozen=True)
class Settings:
    """depth: words of a context at most. least: occurrences a context needs.

    head: part of all tokens from which a word's count goes to every task (1 / head words at most, 20 bytes each); other
    words' counts meet their tokens in a join. The divergence test of one-word contexts takes no word's share to be less.
    block: tokens of a task of the tree, about. spread: occurrences from which a word's rows are dealt over several tasks; no score
    depends on it. hot: occurrences from which a word is split by the word before it, as if the two made one longer word, which
    makes another model: its contexts of length one are then (word, group of the word before). 0: never.
    """

    depth: int = 2
    least: int = 2
    head: float = 1e-6
    block: int = 1_200_000
    spread: int = 500_000
    hot: int = 0


def words_of(text: bytes) -> list[bytes]:
    return text.translate(ASCII_LOWER).split()


def word_counts(df: DataFrame, text: str) -> DataFrame:
    """(w, c): how often each word occurs in all texts, by its XXH64; the word '' stands for the end of a text.

    Two of a billion words share a hash with probability 0.03.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            w, n = _hashed(list(seen)).view(np.int64), np.fromiter(seen.values(), np.int64, len(seen))
            seen.clear()
            for at in range(0, len(w), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(w[at : at + 50_000]), pa.array(n[at : at + 50_000])], ["w", "c"])

        for batch in slices(batches):
            for t in batch.column(0).to_pylist():
                seen.update(words_of(t))
            seen[b""] += batch.num_rows
            if len(seen) > 1_000_000:
                yield from out()
        yield from out()

    return df.select(text_bytes(text).alias("text")).mapInArrow(count, "w long, c long").groupBy("w").agg(F.sum("c").alias("c"))


def _hashed(words: list[bytes]) -> np.ndarray:
    """The words' XXH64."""
    return np.fromiter(map(lambda w: xxhash.xxh64_intdigest(w, 42), words), np.uint64, len(words))


@dataclass
class Root:
    """The unigrams. hashes: of head words, ascending; ranks: theirs by count; c: counts by rank. total, kinds: training's tokens and words."""

    hashes: np.ndarray
    ranks: np.ndarray
    c: np.ndarray
    total: int
    kinds: int
    novel: float
    settings: Settings

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        """Head words' ranks, other words' hashes."""
        if not len(self.hashes):
            return hashes
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.ranks[at].astype(np.uint64), hashes)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 1.0) / (self.total + self.kinds + 1))

    def p(self, c: np.ndarray) -> np.ndarray:
        return (1 - self.novel) * c / max(self.total, 1)


def fit_root(counts: DataFrame, s: Settings = Settings()) -> Root:
    """counts: a written table of (w, c). At most 1 / s.head words reach the driver."""
    got = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"), F.count(F.when(F.col("c") == 1, 1)).alias("once")).first()
    total = got["n"] or 0
    limit = max(1, math.ceil(s.head * total))
    head = counts.where(F.col("c") >= limit).select(F.col("w").alias("h"), "c").toPandas()
    h, c = head["h"].to_numpy(np.int64).view(np.uint64), head["c"].to_numpy(np.int64)
    best = np.lexsort((h, -c))
    h, c = h[best], c[best]
    order = np.argsort(h)
    return Root(h[order], order.astype(np.uint32), c, total, got["v"], (got["once"] + 1) / (total + 2), s)


def _short(codes: np.ndarray) -> np.ndarray:
    """Codes for contexts: 40 bits of a hash. They tell apart what stands before one word, or words of one task, so a few million at most."""
    return np.where(codes < _CODES, codes, codes >> np.uint64(24) | _SHORT)


def _contexts(codes: np.ndarray, first: np.ndarray, depth: int) -> list[np.ndarray]:
    """For every symbol the words before it, nearest first; first: each symbol's place in its text."""
    out = []
    for back in range(1, depth + 1):
        before = np.full(len(codes), _NONE)
        before[back:] = codes[:-back]
        before[first < back] = _NONE
        out.append(before)
    return out


def _split_hot(contexts: list[np.ndarray], root: Root) -> np.ndarray:
    """The nearest words, hot ones (head words by their kind) with their group of the word before as one number beyond all ranks."""
    near = contexts[0]
    if not root.settings.hot or not len(root.c) or root.c[0] <= root.settings.hot or len(contexts) < 2:
        return near
    groups = np.ceil(root.c / root.settings.hot).astype(np.uint64)
    hot = near < _CODES
    n = groups[near[hot].astype(np.int64)]
    group = (contexts[1][hot] * _ODD >> np.uint64(33)) % n
    out = near.copy()
    out[hot] = np.where(n > 1, _short((near[hot] + (group + np.uint64(1)) * _CODES) * _ODD | _CODES), near[hot])
    return out


def _spread(contexts: list[np.ndarray], root: Root) -> np.ndarray:
    """What deals each symbol to a task: its nearest word, and of words with more than spread occurrences the group of the word before."""
    near = contexts[0]
    often = near < np.uint64(spread_words(root))
    if not often.any():
        return near
    groups = np.ceil(root.c[near[often].astype(np.int64)] / root.settings.spread).astype(np.uint64)
    out = near.copy()
    out[often] = near[often] + (contexts[1][often] * _ODD >> np.uint64(33)) % groups * _CODES
    return out


def spread_words(root: Root) -> int:
    """How many words are dealt over several tasks: the first by rank. For contexts of up to two words only, for it's these that whole() tests."""
    return int((root.c > root.settings.spread).sum()) if root.settings.depth == 2 and not root.settings.hot else 0


@dataclass
class Whole:
    """What follows words that several tasks share. path: of a table (w, n) for each such word; of: a word's rank to its occurrences, its followers' number, and whether it is retained; the end, which nothing follows, isn't among them."""

    path: str
    of: dict[int, tuple[int, int, bool]]

    def counts(self, x: int, codes: np.ndarray) -> np.ndarray:
        """How often the words of these codes follow word x in training."""
        files, root = _filesystem(self.path)
        table = pq.read_table(f"{root}/x={x}", columns=["w", "n"], filesystem=files, partitioning=None)
        w, n = table.column(0).to_numpy().view(np.uint64), table.column(1).to_numpy()
        order = np.argsort(w)
        w, n = w[order], n[order]
        at = np.minimum(np.searchsorted(w, codes), len(w) - 1)
        return np.where(w[at] == codes, n[at], 0)


def _followers(df: DataFrame, text: str, root: Root, share: tuple[int, int] | None = None, only: list[int] | None = None) -> DataFrame:
    """(x, before, w, c, n): how often w follows x, a word that several tasks share, and w's count if it is a head word, else 0.

    share (i, k): by the word before x too (its context code, else 0), of the words before the i-th of k parts. only: these x.
    """
    shared, most = df.sparkSession.sparkContext.broadcast(root), spread_words(root)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = shared.value
        wanted = np.zeros(most + 1, bool)
        wanted[list(range(most)) if only is None else only] = True
        for batch in slices(batches):
            seen: dict[bytes, int] = {b"": 0}
            size, ids = [], []
            for t in batch.column(0).to_pylist():
                found = words_of(t)
                size.append(len(found) + 1)
                ids += [seen.setdefault(w, len(seen)) for w in found]
                ids.append(0)
            ids, size = np.array(ids, np.int64), np.array(size, np.int64)
            codes = root.codes(_hashed(list(seen)))
            first = np.arange(len(ids)) - np.repeat(np.cumsum(size) - size, size)
            near, *further = _contexts(_short(codes)[ids], first, 2 if share else 1)
            mine = wanted[np.minimum(near, np.uint64(most)).astype(np.int64)]
            before = further[0] if share else np.zeros(len(ids), np.uint64)
            if share:
                mine &= ((before * _ODD >> np.uint64(40)) % np.uint64(share[1]) == share[0]) & (before != _NONE)
            x, before, w = near[mine].astype(np.int32), before[mine], ids[mine]
            order = np.lexsort((w, before, x))
            x, before, w = x[order], before[order], w[order]
            new = np.ones(len(x), bool)
            new[1:] = (x[1:] != x[:-1]) | (before[1:] != before[:-1]) | (w[1:] != w[:-1])
            at = np.flatnonzero(new)
            n, code = np.diff(np.r_[at, len(x)]), codes[w[at]]
            c = np.zeros(len(at), np.int64)
            c[code < _CODES] = root.c[code[code < _CODES].astype(np.int64)]
            for i in range(0, len(at), 50_000):
                some = slice(i, i + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(x[at[some]]), pa.array(before[at[some]].view(np.int64)), pa.array(code[some].view(np.int64)), pa.array(c[some]), pa.array(n[some])], ["x", "before", "w", "c", "n"])

    rows = df.select(text_bytes(text).alias("text")).mapInArrow(count, "x int, before long, w long, c long, n long")
    return rows.groupBy("x", "before", "w").agg(F.first("c").alias("c"), F.sum("n").alias("n"))


#: Words before in so many parts: one after another is looked through until each shared word has a retained longer context.
SHARES = 16


def whole(df: DataFrame, text: str, root: Root) -> Whole | None:
    """What follows the words that several tasks share, over all rows of df, which are training's; None if there are no such words.

    A word is retained for its own followers' sake or for a longer context's. The former is seen from what follows it; where that doesn't
    do, contexts with the word before are tested, those of a sixteenth of the words before at a time, until one is found or none is left.
    """
    if not spread_words(root):
        return None
    s, total = root.settings, max(root.total, 1)
    path = new_path(df.sparkSession, "followers")
    _followers(df, text, root).select("x", "w", "c", "n").repartition("x", F.pmod("w", F.lit(8))).write.partitionBy("x").parquet(path)
    pairs = df.sparkSession.read.schema("w long, c long, n long, x int").parquet(path)
    costs = 0.5 * math.log(max(root.total, 2))
    gain = F.sum(F.col("n") * F.log(F.col("n") / F.greatest(F.col("c") / total, F.lit(s.head))))
    found = {r["x"]: r for r in pairs.groupBy("x").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds"), gain.alias("gain")).collect()}
    retained = {x for x, r in found.items() if r["n"] >= s.least and r["gain"] - r["n"] * math.log(r["n"]) > costs * r["kinds"]}
    for share in range(SHARES):
        rest = sorted(found.keys() - retained)
        if not rest:
            break
        sizes = df.sparkSession.createDataFrame([(x, found[x]["n"]) for x in rest], "x int, whole long")
        longer = _followers(df, text, root, (share, SHARES), rest).drop("c").join(pairs.select("x", "w", F.col("n").alias("up")), ["x", "w"]).join(F.broadcast(sizes), "x")
        own = longer.groupBy("x", "before").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds"), F.sum(F.col("n") * F.log(F.col("n") * F.col("whole") / F.col("up"))).alias("gain"))
        retained |= {r["x"] for r in own.where((F.col("n") >= s.least) & (F.col("gain") - F.col("n") * F.log("n") > costs * F.col("kinds"))).select("x").distinct().collect()}
    return Whole(path, {x: (r["n"], r["kinds"], x in retained) for x, r in found.items()})


def _planes(a: np.ndarray, width: int) -> bytes:
    """The low bytes of numbers, those of equal weight together."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.dtype.itemsize)[:, :width].T).tobytes()


def _pack(arrays: list[np.ndarray], kinds: list[str]) -> bytes:
    """Numbers as compressed bytes. Kinds: context and word, whose ranks and hashes part ways, and u4."""
    parts, sizes = [], []
    for a, kind in zip(arrays, kinds, strict=True):
        if kind == "u4":
            parts.append(_planes(a.astype("<u4"), 4))
            sizes.append(len(a))
            continue
        tail = a[a >= _CODES]
        parts += [_planes(np.where(a < _CODES, a, _CODES - np.uint64(1)).astype("<u4"), 4), _planes(tail, 5 if kind == "context" else 8)]
        sizes += [len(a), len(tail)]
    data = b"".join(parts)
    return np.array([*sizes, len(data)], "<u4").tobytes() + pa.Codec("zstd", 3).compress(data, asbytes=True)


def _unpack(blob: bytes, kinds: list[str]) -> list[np.ndarray]:
    n_parts = sum(1 if k == "u4" else 2 for k in kinds)
    *sizes, whole = np.frombuffer(blob, "<u4", n_parts + 1).tolist()
    data = pa.Codec("zstd").decompress(blob[4 * (n_parts + 1) :], whole, asbytes=True)
    at, out = 0, []

    def take(width: int, kind: str) -> np.ndarray:
        nonlocal at
        n = sizes.pop(0)
        got = np.zeros((n, np.dtype(kind).itemsize), np.uint8)
        got[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(width, n).T
        at += n * width
        return got.view(kind).reshape(n)

    for kind in kinds:
        if kind == "u4":
            out.append(take(4, "<u4"))
            continue
        code = take(4, "<u4").astype(np.uint64)
        tail = take(5, "<u8") | _SHORT if kind == "context" else take(8, "<u8")
        code[code == _CODES - np.uint64(1)] = tail
        out.append(code)
    return out


def _kinds(depth: int) -> list[str]:
    return ["context"] * depth + ["word"] + ["u4"] * 3


def _dealt(contexts: list[np.ndarray], by: np.ndarray, w: np.ndarray, rep: np.ndarray, weight: np.ndarray, parts: int) -> Iterator[tuple[int, bytes]]:
    """(part, packed rows), dealt by the numbers given: a row is a context, its symbol, the text, how often that text has it, and how many training texts are equal to it."""
    near = contexts[0]
    part = ((by * _ODD) >> np.uint64(20)) % np.uint64(parts)
    rest = w * _ODD
    for c in contexts[1:]:
        rest = (rest ^ c) * _ODD
    key = part << np.uint64(44) | (near * _ODD >> np.uint64(42)) << np.uint64(22) | rest >> np.uint64(42)  # rows of a part, a nearest word and a context stand together
    order = np.argsort(key, kind="stable")
    every = [np.asarray(a)[order] for a in (*contexts, w, rep)]
    new = np.zeros(len(order), bool)
    new[:1] = True
    for a in every:
        new[1:] |= a[1:] != a[:-1]
    at = np.flatnonzero(new)
    tf = np.diff(np.r_[at, len(order)]).astype("<u4")
    every = [a[at] for a in every]
    part = part[order][at]
    edges = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        *words, text = (x[a:b] for x in every)
        yield int(part[a]), _pack([*words, text, tf[a:b], weight[text]], _kinds(len(contexts)))


@dataclass
class States:
    """One task's part of the tree for its rows: a + b p, with p the symbol's unigram probability, is the longest retained suffix state's probability."""

    a: np.ndarray
    b: np.ndarray
    retained: list[int]


def _numbers(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, ascending, and each value's place among them."""
    order = np.argsort(x)
    ordered = x[order]
    new = np.ones(len(x), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    out = np.empty(len(x), np.int32)
    out[order] = np.cumsum(new, dtype=np.int32) - 1
    return ordered[new], out


def states(contexts: list[np.ndarray], w: np.ndarray, weight: np.ndarray, root: Root, whole: Whole | None = None) -> States:
    """Count, test and smooth. contexts: nearest first, whole for their nearest words but those of ``whole``; weight: training occurrences of each row."""
    s = root.settings
    symbols, wi = _numbers(w)
    share = np.full(len(symbols), s.head)
    known = symbols < _CODES
    share[known] = np.maximum(root.c[symbols[known].astype(np.int64)] / max(root.total, 1), s.head)
    state, levels = np.zeros(len(w), np.int32), []
    parent_n, parent_pair = None, None
    for context in contexts:
        kinds, ci = _numbers(context)
        both, now = _numbers(state.astype(np.int64) * len(kinds) + ci)
        first = np.empty(len(both), np.int32)
        first[now[::-1]] = np.arange(len(w) - 1, -1, -1, dtype=np.int32)  # any row of each, here the first
        both, pair = _numbers(now.astype(np.int64) * len(symbols) + wi)
        at = np.empty(len(both), np.int32)
        at[pair[::-1]] = np.arange(len(w) - 1, -1, -1, dtype=np.int32)
        del both, ci
        n_pair = np.bincount(pair, weights=weight, minlength=len(at))
        of = now[at]
        n, kinds = np.bincount(of, weights=n_pair, minlength=len(first)), np.bincount(of, weights=n_pair > 0, minlength=len(first))
        elsewhere = {}
        for i in np.flatnonzero(np.isin(context[first], np.array(list(whole.of), np.uint64))).tolist() if whole and not levels else ():  # pairs stand in order of their contexts
            x, mine = int(context[first[i]]), slice(*np.searchsorted(of, [i, i + 1]))
            n[i], kinds[i], elsewhere[i] = whole.of[x]
            n_pair[mine] = whole.counts(x, symbols[wi[at[mine]]])
        expected = share[wi[at]] if parent_n is None else parent_pair[at] / np.maximum(parent_n[at], 1)
        seen = n_pair > 0
        gain = np.bincount(of[seen], weights=n_pair[seen] * np.log(n_pair[seen] / n[of[seen]] / expected[seen]), minlength=len(first))
        keep = (n >= s.least) & (gain > 0.5 * kinds * math.log(max(root.total, 2))) & (context[first] != _NONE)
        keep[list(elsewhere)] = list(elsewhere.values())
        levels.append((now, first, pair, n_pair, n, kinds, keep))
        parent_n, parent_pair, state = n[now], n_pair[pair], now
    for upper, lower in zip(levels[-2::-1], levels[:0:-1], strict=True):  # with a context, its suffixes
        upper[-1][upper[0][lower[1][lower[-1]]]] = True
    a, b = np.zeros(len(w)), np.ones(len(w))
    for now, _, pair, n_pair, n, kinds, keep in levels:
        held = keep[now]
        whole = np.maximum(n + kinds, 1)[now]
        lower = kinds[now] / whole
        a = np.where(held, n_pair[pair] / whole + lower * a, a)
        b = np.where(held, lower * b, b)
    return States(a, b, [int(keep.sum()) for *_, keep in levels])


def score(df: DataFrame, text: str, keep: list[Column], counts: DataFrame, train: Column, s: Settings = Settings()) -> DataFrame:
    """keep columns, n_tokens, n_known, train_tokens, base_score and score for every row, in place of keep columns of these names.

    counts: a written table of word_counts() over the rows where ``train`` holds; the tree learns from the same rows.
    Null texts count as empty: an end symbol. Repeated rows get equal results; an empty table gives an empty one; where
    nothing was learned every symbol has probability a half. Keys play no part, so null and repeated ones do no harm.
    """
    spark = df.sparkSession
    root = fit_root(counts, s)
    parts = max(spark.sparkContext.defaultParallelism, math.ceil(1.2 * root.total / s.block))
    shared, common = spark.sparkContext.broadcast(root), whole(df.where(train), text, root)
    added = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    every = zip(keep, df.select(*keep).columns, strict=True)
    kept = df.select(*[c.alias(f"k{i}") for i, (c, _) in enumerate(x for x in every if x[1] not in added)], F.coalesce(train, F.lit(False)).alias("train"), text_bytes(text).alias("text"))
    names = [n for n in df.select(*keep).columns if n not in added]
    own_kinds = [f"k{i} {kept.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(names))]
    own = [f"k{i}" for i in range(len(names))]
    width = len(names)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = shared.value
        at = TaskContext.get().partitionId() << 36
        for batch in slices(batches, 6_000_000):
            train, texts = (batch.column(width + i).to_pylist() for i in range(2))
            reps: dict[bytes, int] = {}
            rep_of = [reps.setdefault(t, len(reps)) for t in texts]
            n, rows = len(reps), batch.num_rows
            weight = np.bincount(rep_of, weights=train, minlength=n).astype(np.int64)
            seen: dict[bytes, int] = {b"": 0}
            size, ids = [], []
            for t in reps:
                found = words_of(t)
                size.append(len(found) + 1)
                ids += [seen.setdefault(w, len(seen)) for w in found]
                ids.append(0)
            ids, size = np.array(ids, np.int64), np.array(size, np.int64)
            hashes = _hashed(list(seen))
            codes = root.codes(hashes)
            of = np.repeat(np.arange(n), size)
            first = np.arange(len(ids)) - np.repeat(np.cumsum(size) - size, size)
            code = codes[ids]
            head = code < _CODES
            c = root.c[code[head].astype(np.int64)] if len(root.c) else np.empty(0)
            del seen, hashes
            base, known = np.bincount(of[head], weights=root.base(c), minlength=n), np.bincount(of[head], minlength=n)
            start = first == 0  # no context: the root scores it
            p = np.bincount(of[head & start], weights=np.log10(root.p(c[start[head]])), minlength=n)
            # The first of equal texts is a row with their sums; others name it.
            lead, gid = np.full(n, -1), at + np.arange(rows)
            is_lead = np.zeros(rows, bool)
            for i, r in enumerate(rep_of):
                if lead[r] < 0:
                    lead[r] = i
                    is_lead[i] = True
            rep = np.array(rep_of)
            null = lambda kind, m: pa.nulls(m, kind)
            yield pa.RecordBatch.from_arrays([pa.array((gid % parts).astype(np.int32)), pa.array(gid), null(pa.binary(), rows), pa.array(gid[lead[rep]], mask=is_lead), pa.array(size[rep]), pa.array(known[rep].astype(np.int64)), pa.array(base[rep], pa.float64()), pa.array(p[rep], pa.float64()), null(pa.int64(), rows), *batch.columns[:width]], dealt_columns)
            alone = np.flatnonzero(start & ~head)
            m = len(alone)
            yield pa.RecordBatch.from_arrays([pa.array((gid[lead[of[alone]]] % parts).astype(np.int32)), pa.array(gid[lead[of[alone]]]), null(pa.binary(), m), null(pa.int64(), m), null(pa.int64(), m), *(null(k, m) for k in (pa.int64(), pa.float64(), pa.float64())), pa.array(code[alone].view(np.int64)), *(null(col.type, m) for col in batch.columns[:width])], dealt_columns)
            contexts = _contexts(_short(codes)[ids], first, s.depth)
            contexts[0] = _split_hot(contexts, root)
            inner = ~start
            blobs = list(_dealt([x[inner] for x in contexts], _spread(contexts, root)[inner], code[inner], lead[of[inner]], weight[rep], parts)) if inner.any() else []
            for i in range(0, len(blobs), 200):
                some = blobs[i : i + 200]
                m = len(some)
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in some], pa.int32()), pa.array([at] * m, pa.int64()), pa.array([x for _, x in some], pa.binary()), *(null(k, m) for k in (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64())), *(null(col.type, m) for col in batch.columns[:width])], dealt_columns)
            at += rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, held = shared.value, []
        kinds = _kinds(s.depth)
        for batch in batches:
            if not batch.num_rows:
                continue
            blobs = batch.column(2)
            there = blobs.is_valid()
            for gid, blob in zip(batch.column(1).filter(there).to_pylist(), blobs.filter(there).to_pylist(), strict=True):
                *words, rep, tf, weight = _unpack(blob, kinds)
                held.append([*words, rep.astype(np.int64) + gid, tf.astype(np.int64), tf.astype(np.int64) * weight])
            rest = batch.filter(blobs.is_null())
            if rest.num_rows:
                m = rest.num_rows
                yield pa.RecordBatch.from_arrays([*rest.columns[1:2], *rest.columns[3:7], rest.column(7).cast(pa.float32()), rest.column(8), pa.array(np.ones(m, np.int64)), pa.array(np.zeros(m, np.float32)), pa.array(np.ones(m, np.float32)), *rest.columns[9:]], met_columns)
        if not held:
            return
        *contexts, w, gid, tf, weight = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        got = states(contexts, w, weight, root, common)
        head = w < _CODES
        rank = w[head].astype(np.int64)
        ids, of = np.unique(gid[head], return_inverse=True)
        sums = np.bincount(of, weights=tf[head] * np.log10(got.a[head] + got.b[head] * root.p(root.c[rank])), minlength=len(ids)).astype(float)
        tail = np.flatnonzero(~head)
        # A text's sum rides on the first of its rows here that wait for a count; texts without one have a row for it.
        waiting, lead = np.unique(gid[tail], return_index=True)
        place = np.minimum(np.searchsorted(ids, waiting), max(len(ids) - 1, 0))
        both = ids[place] == waiting if len(ids) else np.zeros(len(waiting), bool)
        rides, alone = np.full(len(tail), np.nan), np.ones(len(ids), bool)
        rides[lead[both]] = sums[place[both]]
        alone[place[both]] = False
        ids, sums = ids[alone], sums[alone]
        no = lambda kind, m: pa.nulls(m, kind)
        for i in range(0, len(ids), 50_000):
            m = len(ids[i : i + 50_000])
            yield pa.RecordBatch.from_arrays([pa.array(ids[i : i + 50_000]), *(no(k, m) for k in (pa.int64(), pa.int64(), pa.int64(), pa.float64())), pa.array(sums[i : i + 50_000].astype(np.float32)), *(no(k, m) for k in (pa.int64(), pa.int64(), pa.float32(), pa.float32(), *own_types))], met_columns)
        for i in range(0, len(tail), 50_000):
            x = tail[i : i + 50_000]
            m, ride = len(x), rides[i : i + 50_000].astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array(gid[x]), *(no(k, m) for k in (pa.int64(), pa.int64(), pa.int64(), pa.float64())), pa.array(ride, mask=np.isnan(ride)), pa.array(w[x].view(np.int64)), pa.array(tf[x]), pa.array(got.a[x].astype(np.float32)), pa.array(got.b[x].astype(np.float32)), *(no(k, m) for k in own_types)], met_columns)

    from pyspark.sql.pandas.types import to_arrow_type

    own_types = [to_arrow_type(kept.schema[c].dataType) for c in own]
    dealt_columns = ["part", "gid", "blob", "like", "n_tokens", "known", "base", "model", "h", *own]
    met_columns = ["gid", "like", "n_tokens", "known", "base", "model", "h", "tf", "a", "b", *own]
    tail_of = "".join(f", {k}" for k in own_kinds)
    dealt = kept.mapInArrow(deal, f"part int, gid long, blob binary, like long, n_tokens long, known long, base double, model double, h long{tail_of}")
    rows = dealt.repartitionById(parts, F.col("part")).mapInArrow(run, f"gid long, like long, n_tokens long, known long, base double, model float, h long, tf long, a float, b float{tail_of}")
    limit = max(1, math.ceil(s.head * root.total))
    counted = counts.where(F.col("c") < limit).select("w", F.lit(True).alias("is_word"), "c").hint("shuffle_hash")
    met = rows.select("*", F.col("h").isNotNull().alias("is_word"), F.coalesce("h", F.xxhash64("gid")).alias("w")).join(counted, ["w", "is_word"], "left")  # rows without a word are dealt evenly
    c = F.coalesce("c", F.lit(0))
    p = F.when(F.col("c").isNull(), F.lit(root.novel)).otherwise(c * F.lit((1 - root.novel) / max(root.total, 1)))
    base = F.when(F.col("is_word"), F.col("tf") * F.log10((c + 1) / F.lit(float(root.total + root.kinds + 1)))).otherwise(F.col("base"))
    model = F.when(F.col("is_word"), F.col("tf") * F.log10(F.col("a") + F.col("b") * p)).otherwise(F.lit(0.0)) + F.coalesce("model", F.lit(0.0))
    known = F.when(F.col("is_word"), F.when(F.col("c").isNotNull(), F.col("tf")).otherwise(0)).otherwise(F.col("known"))
    summed = met.groupBy("gid").agg(F.max("like").alias("like"), F.max("n_tokens").alias("n_tokens"), F.sum(known).alias("n_known"), F.sum(base).alias("base_score"), F.sum(model).alias("score"), *[F.max(c).alias(c) for c in own])
    summed = materialise(summed, "scores")
    numbers = ["n_tokens", F.col("n_known").cast("long").alias("n_known"), F.lit(root.total).cast("long").alias("train_tokens"), "base_score", "score"]
    alike = summed.where("like IS NOT NULL").select(F.col("like").alias("to"), *own).join(summed.drop(*own, "like").hint("merge"), F.col("to") == F.col("gid"))
    named = [F.col(c).alias(n) for c, n in zip(own, names, strict=True)]
    return summed.where("like IS NULL").select(*named, *numbers).union(alike.select(*named, *numbers))


def op8_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's base score and its suffix tree's; null texts count as empty, repeated rows get equal results."""
    docs = documents(spark, sf_dir)
    held = residue("doc_id", 7) == 2
    counts = materialise(word_counts(docs.where(~held), "text"), "words")
    return score(docs, "text", [F.col("doc_id"), held.alias("held_out")], counts, ~held)
