"""Benchmark decontamination by latent semantic retrieval.

Passages (blocks of words) are TF-IDF vectors over the benchmark's words. A randomised, distributed SVD of all
passages (a Gaussian sketch of their Gram matrix in one pass, then Nystroem's form) gives a latent basis, without
the few leading directions that tell languages and function words apart; items and overlapping windows of every
text are compared by cosine there. Windows that are near an item, and that by bit sets hold enough of its
words, are checked word for word: the longest common subsequence's part of the item, and, where that alone
doesn't settle it, the item's answer.

Beside the cosine there is an exact path, so that no window that passes the check goes unchecked: if m words of an item
may be missing, a window must have k of the item's m + k rarest words, whatever k is, and all but m of its words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm._common import documents, materialise, slices, text_bytes

_FOLD = bytes((c + 32 if 65 <= c <= 90 else 32 if c < 48 or 57 < c < 65 or 90 < c < 97 or 122 < c < 128 else c) for c in range(256))


@dataclass(frozen=True)
class Settings:
    """rank: latent dimensions, of which the leading ``common`` part is left out. passage: words of a block. near: cosine
    from which a window is checked. rare: inverse document frequency from which a word has weight (2.5: in under 9 % of
    passages). held: part of an item's distinct words with weight that a checked window must hold.

    verbatim: part of an item's words in common order that settles it. paraphrase: part that needs the answer too,
    which must be there to the part ``answer``; an item without one has its last third for an answer.
    block: windows, and items, of one product of matrices: a task's memory doesn't grow with either.
    largest: bytes that the items' terms may take in every task; a larger benchmark is an error that says so.
    """

    rank: int = 96
    common: float = 1 / 12
    passage: int = 32
    near: float = 0.35
    rare: float = 2.5
    held: float = 0.4
    verbatim: float = 0.75
    paraphrase: float = 0.55
    answer: float = 0.8
    block: int = 2048
    largest: int = 1_000_000_000
    seed: int = 11


def words_of(text: bytes) -> list[bytes]:
    """Words without ASCII case and punctuation."""
    return text.translate(_FOLD).split()


@dataclass
class _Item:
    key: int
    words: np.ndarray  # term numbers
    answer: frozenset


@dataclass
class _Plan:
    terms: dict[bytes, int]
    items: list[_Item]


def _plan(rows: list, has_answer: bool) -> _Plan:
    terms: dict[bytes, int] = {}
    items = []
    for r in rows:
        found = words_of((r["text"] or "").encode())
        if not found:
            continue
        ids = np.array([terms.setdefault(w, len(terms)) for w in found], np.int64)
        said = words_of((r["answer"] or "").encode()) if has_answer else []
        answer = frozenset(terms.setdefault(w, len(terms)) for w in said) if said else frozenset(ids[len(ids) - max(1, len(ids) // 3) :].tolist())
        items.append(_Item(r["key"], ids, answer))
    return _Plan(terms, items)


def _ids(text: bytes, terms: dict[bytes, int]) -> np.ndarray:
    """Each word's term number, -1 for words that the benchmark doesn't have."""
    get = terms.get
    found = words_of(text)
    return np.fromiter([get(w, -1) for w in found], np.int64, len(found))


def _kind(terms: int) -> str:
    return "<i2" if terms < 1 << 15 else "<i4"


def _numbered(docs: DataFrame, key: str, text: str, plan: _Plan) -> DataFrame:
    """A written table (key, words): every text's term numbers. Texts are read and cut into words once; what follows reads this."""
    shared = docs.sparkSession.sparkContext.broadcast(plan.terms)
    kind = _kind(len(plan.terms))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_ids(t, shared.value).astype(kind).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], ["key", "words"])

    rows = docs.select(F.col(key).alias("key"), text_bytes(text).alias("text"))
    return materialise(rows.mapInArrow(number, f"key {docs.schema[key].dataType.simpleString()}, words binary"), "numbered")


def _arrays(column: pa.Array, terms: int) -> list[np.ndarray]:
    kind = _kind(terms)
    return [np.frombuffer(x, kind).astype(np.int64) for x in column.to_pylist()]


def _blocks(column: pa.Array, size: int, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Term numbers of the texts' words that count with the block each is in, and the blocks' number. counts: one flag a term and a last one for other words."""
    terms_at, block_at, blocks = [], [], 0
    for ids in _arrays(column, len(counts) - 1):
        known = np.flatnonzero(counts[ids])
        terms_at.append(ids[known])
        block_at.append(known // size + blocks)
        blocks += -(-len(ids) // size)
    return np.concatenate(terms_at), np.concatenate(block_at), blocks


def _summed(rows: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by their (ascending) group, for groups 0 to n - 1."""
    out = np.zeros((n, rows.shape[1]), np.float32)
    if len(of):
        first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        out[of[first]] = np.add.reduceat(rows, first, axis=0)
    return out


def _idf(texts: DataFrame, plan: _Plan, s: Settings) -> np.ndarray:
    """Inverse document frequency of every term over all passages."""
    d = len(plan.terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, passages, every = np.zeros(d, np.int64), 0, np.r_[np.ones(d, bool), False]
        for batch in slices(batches, 1_000_000, "words"):
            t, b, n = _blocks(batch.column(0), s.passage, every)
            df += np.bincount(np.unique(b * d + t) % d, minlength=d)
            passages += n
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, some]), pa.array(np.r_[passages, df[some]])], ["term", "n"])

    found = texts.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(len(plan.terms))
    at = found["term"].to_numpy(np.int64)
    df[at[at >= 0]] = found["n"].to_numpy(float)[at >= 0]
    total = float(found["n"].to_numpy(float)[at < 0].sum())
    return np.log((total + 1) / (df + 1)) + 0.1


def _weights(idf: np.ndarray, s: Settings) -> np.ndarray:
    """Inverse document frequencies of the terms that have weight, 0 for others. Items of common words alone are met on the exact path."""
    return np.where(idf >= s.rare, idf, 0.0)


def _basis(texts: DataFrame, plan: _Plan, idf: np.ndarray, s: Settings) -> np.ndarray:
    """Terms by rank: the latent basis. Its columns span the leading right singular vectors of all passages' TF-IDF matrix."""
    d = len(plan.terms)
    rank = min(s.rank, d)
    sketch = np.random.default_rng(s.seed).standard_normal((d, rank)).astype(np.float32)
    shared = texts.sparkSession.sparkContext.broadcast(((idf[:, None] * sketch).astype(np.float32), np.r_[idf > 0, False]))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weighted, counts = shared.value
        total = np.zeros((d, rank))
        for batch in slices(batches, 100_000, "words"):
            t, b, n = _blocks(batch.column(0), s.passage, counts)
            z = _summed(weighted[t], b, n)
            order = np.argsort(t, kind="stable")
            total += _summed(z[b[order]], t[order], d)
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([row.tobytes() for row in total], pa.binary())], ["term", "row"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for t, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[t] = total.get(t, 0) + np.frombuffer(row)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([r.tobytes() for r in total.values()], pa.binary())], ["term", "row"])

    y = np.zeros((d, rank))
    for r in texts.mapInArrow(project, "term int, row binary").repartition("term").mapInArrow(add, "term int, row binary").toLocalIterator():
        y[r["term"]] = np.frombuffer(r["row"])
    y *= idf[:, None]  # = G sketch, with G the passages' Gram matrix
    shift = 1e-6 * float(np.abs(y).max() or 1)
    core = sketch.T @ y
    core = (core + core.T) / 2 + shift * sketch.T @ sketch
    values, vectors = np.linalg.eigh(core)
    keep = values > 1e-9 * max(values.max(), 1e-300)
    b = (y + shift * sketch) @ (vectors[:, keep] / np.sqrt(values[keep]))
    u, _, _ = np.linalg.svd(b, full_matrices=False)
    return u[:, int(s.common * u.shape[1]) :].astype(np.float32)


def lcs(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, a bit for every element of a."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b.tolist():
        m = masks.get(x)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _rarest(words: np.ndarray, rate: np.ndarray, s: Settings) -> tuple[int, np.ndarray, int]:
    """How many of an item's words a window that holds it may lack, and the rarest words of which it must have so many.

    rate: each term's expected number in a window. The number is that which the fewest windows reach by chance, if words fell independently.
    """
    least = min(s.verbatim, s.paraphrase)
    need = next(c for c in range(1, len(words) + 1) if c / len(words) >= least or c == len(words))
    lack = len(words) - need
    order = words[np.argsort(rate[words], kind="stable")]
    best = (math.inf, 1)
    for k in range(1, need + 1):
        mean = float(rate[np.unique(order[: lack + k])].sum())
        term, below = math.exp(-mean), 0.0
        for j in range(k):
            below += term
            term *= mean / (j + 1)
        best = min(best, (max(1 - below, 1e-9), k))
    return lack, np.unique(order[: lack + best[1]]), best[1]


_SET_WORDS = 8  # unsigned 64-bit numbers of a set of words


class _Searcher:
    """Items and windows in the latent space, by the items' size."""

    def __init__(self, plan: _Plan, idf: np.ndarray, rate: np.ndarray, basis: np.ndarray, s: Settings) -> None:
        """rate: parts of all passages that have each term."""
        self.plan, self.s = plan, s
        self.weighted = (idf[:, None] * basis).astype(np.float32)
        self.counts = np.r_[idf > 0, False]
        bit = np.random.default_rng(s.seed).integers(0, 64 * _SET_WORDS, len(plan.terms))
        self.sets = np.zeros((len(plan.terms), _SET_WORDS), np.uint64)
        self.sets[np.arange(len(bit)), bit // 64] = np.uint64(1) << (bit % 64).astype(np.uint64)
        sizes: dict[int, list[int]] = {}
        for i, item in enumerate(plan.items):
            sizes.setdefault(-(-len(item.words) // 16), []).append(i)
        self.groups = {}
        self.exact = {}
        self.rare = np.zeros(len(plan.terms) + 1, bool)  # a last one for other words
        for size, members in sorted(sizes.items()):
            found = [_rarest(plan.items[i].words, rate * 16 * (size + 1) / s.passage, s) for i in members]
            of = np.concatenate([terms for _, terms, _ in found])
            who = np.repeat(np.arange(len(members)), [len(terms) for _, terms, _ in found])[np.argsort(of, kind="stable")]
            degree = np.bincount(of, minlength=len(plan.terms) + 1)
            self.rare[of] = True
            self.exact[size] = (degree, np.cumsum(degree) - degree, who, np.array([k for *_, k in found]), np.array([lack for lack, *_ in found]))
            # size: blocks of 16 words; a window has one more, so that an item lies wholly within one, wherever it starts
            m = np.array([self.weighted[plan.items[i].words].sum(axis=0) for i in members])
            held = np.array([np.bitwise_or.reduce(self.sets[plan.items[i].words[self.counts[plan.items[i].words]]], axis=0) for i in members])
            self.groups[size] = (np.array(members), m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9), held)

    def texts(self, every: list[np.ndarray]) -> list[tuple[int, int, float, float, int, str]]:
        """(text, item, cosine, common part, first word, how) for each item found in each text, given as term numbers."""
        first = np.cumsum([0, *(-(-len(ids) // 16) for ids in every)])
        known = [np.flatnonzero(self.counts[ids]) for ids in every]
        terms = np.concatenate([ids[k] for ids, k in zip(every, known, strict=True)])
        at = np.concatenate([k // 16 + f for k, f in zip(known, first[:-1], strict=True)])
        n = int(first[-1])
        text_of = np.repeat(np.arange(len(every)), np.diff(first))
        rare = [np.flatnonzero(self.rare[ids]) for ids in every]
        rare_terms = np.concatenate([ids[k] for ids, k in zip(every, rare, strict=True)])
        rare_at = np.concatenate([k // 16 + f for k, f in zip(rare, first[:-1], strict=True)])
        if not len(terms) and not len(rare_terms):
            return []
        blocks, sets = _summed(self.weighted[terms], at, n), np.zeros((n, _SET_WORDS), np.uint64)
        if len(terms):
            edge = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            sets[at[edge]] = np.bitwise_or.reduceat(self.sets[terms], edge, axis=0)
        best: dict[tuple[int, int], tuple[float, float, int, str]] = {}
        for size, (members, vectors, held) in self.groups.items():
            window, there = blocks.copy(), sets.copy()
            for j in range(1, min(size, n - 1) + 1):  # a text's last windows end with it
                same = text_of[j:] == text_of[:-j]
                window[:-j] += np.where(same[:, None], blocks[j:], 0)
                there[:-j] |= np.where(same[:, None], sets[j:], np.uint64(0))
            window /= np.maximum(np.linalg.norm(window, axis=1, keepdims=True), 1e-9)
            bits = np.bitwise_count(held).sum(axis=1).astype(np.int64)
            near = []
            for a in range(0, n, self.s.block):
                for b in range(0, len(members), self.s.block):
                    w, i = np.nonzero(window[a : a + self.s.block] @ vectors[b : b + self.s.block].T >= self.s.near)
                    w, i = w + a, i + b
                    good = np.bitwise_count(there[w] & held[i]).sum(axis=1) >= self.s.held * bits[i]
                    near.append(w[good] * len(members) + i[good])
            w, i = self.possible(size, rare_terms, rare_at, text_of)
            good = np.bitwise_count(there[w] & held[i]).sum(axis=1) >= bits[i] - self.exact[size][4][i]  # a word that is missing takes one bit at most
            w, i = np.divmod(np.union1d(np.concatenate(near), w[good] * len(members) + i[good]), len(members))
            cos = (window[w] * vectors[i]).sum(axis=1)
            of = text_of[w]
            for w_, i_, d, c in zip(w.tolist(), i.tolist(), of.tolist(), cos.tolist(), strict=True):
                start = 16 * (w_ - int(first[d]))
                self.verify(every[d][start : start + 16 * (size + 1)], d, int(members[i_]), round(c, 5), start, best)
        return [(*k, *v) for k, v in sorted(best.items())]

    def possible(self, size: int, terms: np.ndarray, at: np.ndarray, text_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows (by first block) and items of a size, where the window has as many of the item's rarest words as it must. terms, at: such words and their blocks; text_of: each block's text."""
        degree, start, who, least, _ = self.exact[size]
        each = degree[terms]
        nth = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        items = len(least)
        pair, n = np.unique(np.repeat(at, each) * items + who[np.repeat(start[terms], each) + nth], return_counts=True)
        if not len(pair):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        block = np.repeat(pair // items, size + 1)
        back = np.tile(np.arange(size + 1), len(pair))
        inside = (block >= back) & (text_of[block - np.minimum(back, block)] == text_of[block])
        pair, n = (np.repeat(pair, size + 1) - back * items)[inside], np.repeat(n, size + 1)[inside]
        order = np.argsort(pair, kind="stable")
        pair, n = pair[order], n[order]
        edge = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
        pair, n = pair[edge], np.add.reduceat(n, edge)
        good = n >= least[pair % items]
        return np.divmod(pair[good], items)

    def verify(self, window: np.ndarray, text: int, i: int, cos: float, at: int, best: dict) -> None:
        item = self.plan.items[i]
        if best.get((text, i), (0, 0))[1] == 1:
            return
        part = lcs(item.words, window) / len(item.words)
        if part >= self.s.verbatim:
            how = "verbatim" if part == 1 else "near"
        elif part >= self.s.paraphrase and len(item.answer & set(window.tolist())) >= self.s.answer * len(item.answer):
            how = "paraphrase"
        else:
            return
        if (text, i) not in best or part > best[text, i][1]:
            best[text, i] = (cos, part, at, how)


def search(docs: DataFrame, key: str, text: str, benchmark: DataFrame, item: str = "item_id", item_text: str = "text", answer: str | None = None, s: Settings = Settings()) -> DataFrame:
    """(key, item_id, cosine, common, first_word, how): every text that holds an item, one row for each of its items.

    Null and empty texts and items match nothing; repeated rows give repeated rows, and of an item's windows of one common
    part the first counts; an empty table on either side gives an empty result. The benchmark is held in every task, as
    far as s.largest allows: its size is that of the benchmark and not of the documents. One vocabulary, one set of weights
    and one basis serve all items, and windows end with their text, so neither partitions nor batches change a row.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, item_id long, cosine double, common double, first_word long, how string"
    items = benchmark.select(F.col(item).cast("long").alias("key"), F.col(item_text).alias("text"), (F.col(answer) if answer else F.lit(None).cast("string")).alias("answer"))
    size = items.agg(F.sum(F.octet_length("text") + F.coalesce(F.octet_length("answer"), F.lit(0)))).first()[0] or 0
    if size // 6 * 4 * s.rank > s.largest:  # a term for every six bytes at most, and a vector for each
        raise ValueError(f"a benchmark of {size} bytes is more than tasks can hold")
    plan = _plan(items.collect(), answer is not None)
    if not plan.items:
        return spark.createDataFrame([], schema)
    numbered = _numbered(docs, key, text, plan)
    texts = numbered.select("words")
    every = _idf(texts, plan, s)
    idf = _weights(every, s)
    shared = spark.sparkContext.broadcast(_Searcher(plan, idf, np.exp(0.1 - every), _basis(texts, plan, idf, s), s))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = shared.value
        for batch in slices(batches, 100_000, "words"):
            keys = batch.column(0).to_pylist()
            found = [(keys[d], searcher.plan.items[i].key, *v) for d, i, *v in searcher.texts(_arrays(batch.column(1), len(searcher.plan.terms)))]
            if found:
                columns = list(zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.column(0).type), pa.array(columns[1], pa.int64()), *(pa.array(c, pa.float64()) for c in columns[2:4]), pa.array(columns[4], pa.int64()), pa.array(columns[5])], ["key", "item_id", "cosine", "common", "first_word", "how"])

    return numbered.mapInArrow(run, schema)


def op4_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, a row for each item; null and empty texts hold none."""
    return search(documents(spark, sf_dir), "doc_id", "text", spark.read.parquet(f"{sf_dir}/benchmark.parquet")).withColumnRenamed("key", "doc_id")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", s: Settings = Settings()) -> DataFrame:
    """The rows of docs whose text holds no benchmark item, with their columns as they are.

    Rows with a null key all stay, and so do null and empty texts; of a repeated key all rows go if one's text holds an item.
    """
    bad = search(docs.where(F.col(f"`{key}`").isNotNull()), key, text, benchmark, s=s).select(F.col("key").alias("__bad")).distinct()
    return docs.join(bad, F.col(f"`{key}`") == F.col("__bad"), "left_anti")
