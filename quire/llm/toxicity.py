"""Toxicity scores of deobfuscated text.

Tokens that look disguised (digits or signs among letters, separators between letters, runs of one character,
words spelt out with spaces) are read as the output of a noisy channel: a lattice of what each character may
stand for is decoded by Viterbi under a character trigram model, and the restored word takes the token's
place. A text's evidence is the sum of its strongest words' weights, which are log odds of words, word
beginnings and word ends between toxic and other training texts; a logistic curve, fitted on texts that the
weights haven't seen, makes it a probability.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm._common import documents, fit_logistic, materialise, nth_smallest, residue, slices

THRESHOLD = 0.3
#: What a sign may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "¥": "y", "&": "e", "#": "h"}
SEPARATORS = ".-_*'~·,/\\^`:;"
_EDGE = ".,;:!?\"'()[]{}<>…»«“”‘’-_*~`"
_INSIDE = re.compile("[" + re.escape("".join(LEET) + SEPARATORS) + "]")
_RUN = re.compile(r"(.)\1\1")
_LETTER = re.compile(r"[^\W\d_]")
_SPELT_HINT = re.compile(r" \S \S \S(?!\S)| \S  ?\S  ?\S ")
_SPELT = re.compile(r"(?<!\S)\S(?: {1,2}\S){3,}(?!\S)")


@dataclass(frozen=True)
class Settings:
    """least: toxic texts that must hold a feature.

    features, words: the strongest features kept, and the most frequent words that train the character model, at most.
    These bound the model, whose counts are of all labelled texts; every text is scored on all its words.
    sure: standard errors by which a feature's log odds are lowered. strongest: the evidence is the sum of so many largest
    weights, so that a long text isn't toxic by its length. beam: states that decoding keeps; 0 keeps all and is exact
    (on the fixtures' disguised tokens both give the same words).
    """

    least: int = 3
    features: int = 20_000
    words: int = 30_000
    sure: float = 3.0
    strongest: int = 8
    beam: int = 64


class CharacterModel:
    """Interpolated character trigrams over lower-case words; costs are negative natural logs."""

    def __init__(self, words: dict[str, int]) -> None:
        self.tri: dict[str, float] = defaultdict(float)
        self.bi: dict[str, float] = defaultdict(float)
        self.uni: dict[str, float] = defaultdict(float)
        for w, n in words.items():
            s = f"  {w} "
            for i in range(2, len(s)):
                self.tri[s[i - 2 : i + 1]] += n
                self.bi[s[i - 1 : i + 1]] += n
                self.uni[s[i]] += n
        self.tri_of, self.bi_of = defaultdict(float), defaultdict(float)
        for k, n in self.tri.items():
            self.tri_of[k[:2]] += n
        for k, n in self.bi.items():
            self.bi_of[k[0]] += n
        self.total = sum(self.uni.values())
        for d in (self.tri, self.bi, self.uni, self.tri_of, self.bi_of):
            d.default_factory = None

    def cost(self, context: str, ch: str) -> float:
        p = (self.uni.get(ch, 0) + 0.5) / (self.total + 200)
        p = (self.bi.get(context[1] + ch, 0) + 2 * p) / (self.bi_of.get(context[1], 0) + 2)
        p = (self.tri.get(context + ch, 0) + 2 * p) / (self.tri_of.get(context, 0) + 2)
        return -math.log(p)

    def decode(self, token: str, beam: int = 64) -> str:
        """The likeliest word behind a token: letters stand for themselves, signs for letters or nothing, repeats for one or two.

        States are the last two letters; beam bounds them, so time is in proportion to the token's length. Without one (0) the result is exact.
        """
        states: dict[tuple[str, str], tuple[float, tuple | None]] = {("  ", ""): (0.0, None)}
        runs = [len(m.group()) for m in re.finditer(r"(.)\1*", token, re.S) for _ in m.group()]
        for ch, run in zip(token, runs, strict=True):
            options = [(x, 1.0) for x in LEET.get(ch, "")]
            if ch.isalpha():
                options.append((ch, 0.1))
            silent = 0.5 if ch in SEPARATORS or ch == " " else None if ch.isalpha() else 6.0
            after: dict[tuple[str, str], tuple[float, tuple | None]] = {}
            for (context, last), (cost, path) in states.items():
                steps = [(context[1] + x, ch, cost + c + self.cost(context, x), (x, path)) for x, c in options]
                if silent is not None:
                    steps.append((context, last, cost + silent, path))
                elif ch == last:
                    steps.append((context, last, cost + (0.7 if run > 2 else 4.0), path))  # words have double letters
                for to, seen, c, way in steps:
                    if (to, seen) not in after or c < after[to, seen][0]:
                        after[to, seen] = (c, way)
            if not after:  # a character that stands for nothing known
                after = {k: (c + 8.0, p) for k, (c, p) in states.items()}
            states = dict(heapq.nsmallest(beam, after.items(), key=lambda x: x[1][0])) if 0 < beam < len(after) else after
        _, path = min(((c + self.cost(context, " "), i, p) for i, ((context, _), (c, p)) in enumerate(states.items())), key=lambda x: x[:2])[1:]
        out = []
        while path:
            x, path = path
            out.append(x)
        return "".join(reversed(out))


def disguised(token: str) -> bool:
    """Whether a token (lower case, without edge punctuation) is worth decoding: letters mixed with signs, or a run of three."""
    return len(token) >= 3 and bool(_LETTER.search(token)) and bool(_INSIDE.search(token) or _RUN.search(token))


def spelt_out(text: str) -> list[str]:
    """Words written with a space after every character, joined."""
    if not _SPELT_HINT.search(f" {text}"):
        return []
    return [m.group().replace(" ", "") for m in _SPELT.finditer(text)]


def word_features(word: str) -> list[str]:
    out = ["=" + word]
    for k in (4, 5, 6):
        if len(word) > k:
            out += ["^" + word[:k], "$" + word[-k:]]
    return out


@dataclass
class Model:
    """texts: how many it learned from."""

    weights: dict[str, float]
    characters: CharacterModel
    slope: float
    bias: float
    settings: Settings
    texts: int = 0
    kept: dict[str, tuple[float, str] | None] = field(default_factory=dict)

    def __getstate__(self):
        return self.__dict__ | {"kept": {}}

    def word(self, token: str) -> tuple[float, str] | None:
        """A token's strongest feature's weight, and the word it stands for; None where it has none."""
        plain = token.lower().strip(_EDGE)
        found = [plain] if plain.isalpha() else []
        low = token.lower()
        core = low.strip(".,;:?\"'()[]{}<>…»«“”‘’`") if not plain.isalpha() or _RUN.search(plain) else ""
        if core and disguised(core):
            found.append(self.characters.decode(core, self.settings.beam))
        elif not found:
            found = _LETTERS_RUN.findall(plain)
        return max(((self.weights[f], w) for w in found if w for f in word_features(w) if f in self.weights), default=None)

    def evidence(self, text: str) -> float:
        kept, found = self.kept, set()
        if len(kept) > 400_000:
            kept.clear()
        for token in {*text.split(), *spelt_out(text)}:
            try:
                got = kept[token]
            except KeyError:
                got = kept[token] = self.word(token)
            if got is not None:
                found.add(got)
        return sum(w for w, _ in heapq.nlargest(self.settings.strongest, found))

    def score(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * evidence + self.bias))))


_LETTERS_RUN = re.compile(r"[^\W\d_]+")


class _Features(dict):
    """A word to its features."""

    def __missing__(self, word: str) -> list[str]:
        self[word] = got = word_features(word)
        return got


def _without_echoes(rows: list) -> list:
    """Rows of features without beginnings and ends that owe half of their texts or more to one word."""
    most: dict[str, int] = {}
    for r in rows:
        if r["feature"][0] == "=":
            for f in word_features(r["feature"][1:])[1:]:
                most[f] = max(most.get(f, 0), r["t"])
    return [r for r in rows if 2 * most.get(r["feature"], 0) < r["t"]]


def _highest(df: DataFrame, column: str, most: int) -> DataFrame:
    """The rows with the highest values, and those as high as the last of them: so each task sends the driver only what may be among the most."""
    n = df.count()
    return df if n <= most else df.where(F.col(column) >= nth_smallest(df, column, n - most))


def fit(labelled: DataFrame, key: str, text: str, label: str, s: Settings = Settings()) -> Model:
    """Learn from all labelled texts (label 1: toxic). Rows without a label are left out; no rows give a model that says 0.5 at most."""
    rows = labelled.where(F.col(label).isNotNull()).select(F.coalesce(F.col(text), F.lit("")).alias("text"), (F.col(label) > 0).cast("int").alias("y"), F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(2)).cast("int").alias("half"))
    rows = materialise(rows, "labelled", compression="zstd")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features: list[Counter] = [Counter() for _ in range(4)]
        words: Counter = Counter()
        of = _Features()

        def out() -> Iterator[pa.RecordBatch]:
            for kind, counter, sign in (*((k, c, "") for k, c in enumerate(features)), (0, words, " ")):
                f, n = list(counter), list(counter.values())
                for at in range(0, len(f), 50_000):
                    some = [sign + x for x in f[at : at + 50_000]]
                    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([kind] * len(some), pa.int32()), pa.array(n[at : at + 50_000], pa.int64())], ["feature", "kind", "n"])
                counter.clear()
            of.clear()

        for batch in slices(batches):
            for body, y, half in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                found = _LETTERS_RUN.findall(body.lower())
                words.update(found)
                features[2 * half + y].update(set().union(*map(of.__getitem__, set(found))))
            if sum(map(len, features)) > 600_000:
                yield from out()
        yield from out()

    counts = rows.mapInArrow(count, "feature string, kind int, n long").groupBy("feature").agg(*[F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(4)], F.sum("n").alias("n"))
    t, c = F.col("n1") + F.col("n3"), F.col("n0") + F.col("n2")
    counts = materialise(counts.where(F.col("feature").startswith(" ") | (t >= s.least)), "features")
    of = {(r["half"], r["y"]): r["count"] for r in rows.groupBy("half", "y").count().collect()}
    total = {y: of.get((0, y), 0) + of.get((1, y), 0) for y in (0, 1)}

    def odds(t: Column, c: Column, nt: int, nc: int) -> Column:
        return F.log((t + 0.5) / (nt + 1) * (nc + 1) / (c + 0.5)) - s.sure * F.sqrt(1 / (t + 0.5) + 1 / (c + 0.5))

    chosen = counts.where(~F.col("feature").startswith(" ")).select("feature", t.alias("t"), odds(t, c, total[1], total[0]).alias("w"), odds(F.col("n1"), F.col("n0"), of.get((0, 1), 0), of.get((0, 0), 0)).alias("w0"), odds(F.col("n3"), F.col("n2"), of.get((1, 1), 0), of.get((1, 0), 0)).alias("w1")).where("w > 0.5")
    best = _highest(chosen, "w", s.features).orderBy(F.desc("w"), "feature").limit(s.features).collect()
    best = _without_echoes(best)
    words = {r["feature"][1:]: r["n"] for r in _highest(counts.where(F.col("feature").startswith(" ")), "n", s.words).orderBy(F.desc("n"), "feature").limit(s.words).collect()}
    for r in best:  # the character model must know the words that count
        if r["feature"][0] == "=":
            words[r["feature"][1:]] = max(words.get(r["feature"][1:], 0), 50)
    characters = CharacterModel(words)
    halves = [Model({r["feature"]: r[f"w{h}"] for r in best if r[f"w{h}"] > 0.5}, characters, 1.0, 0.0, s) for h in (0, 1)]
    shared = rows.sparkSession.sparkContext.broadcast(halves)

    def unseen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            got = [(shared.value[1 - half].evidence(body), y) for body, y, half in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([e for e, _ in got], pa.float64()), pa.array([y for _, y in got], pa.int32())], ["e", "y"])

    slope, bias = fit_logistic(materialise(rows.mapInArrow(unseen, "e double, y int"), "seen"), "e", "y")
    return Model({r["feature"]: r["w"] for r in best}, characters, slope, bias, s, sum(of.values()))


def score(df: DataFrame, text: str, keep: list[Column], model: Model) -> DataFrame:
    """keep columns and the score of every row, in place of a keep column of that name.

    Null texts count as empty, whose score is the curve's at no evidence; rows are judged one by one, so repeated rows get
    equal scores and an empty table gives an empty one.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    kept = df.select(*[c for c, n in zip(keep, df.select(*keep).columns, strict=True) if n != "score"], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text"))
    names = kept.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches, column="__text"):
            got = [model.score(model.evidence(t)) for t in batch.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(got, pa.float64())], [*names, "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "__text")
    return kept.mapInArrow(run, f"{schema}, score double")


def labelled_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic) of all the training fold's labelled rows. Of an id's several labels a toxic one counts.

    Neither side is bounded, so they meet by a shuffle. What crosses it are texts whose id's hash is among the labelled ids'
    hashes, by bitmaps of 16 bits a label: those with a label, and a sixteenth of the others.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (residue("doc_id", 4) != 2)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = materialise(known, "labels")
    place = F.pmod(F.xxhash64("doc_id"), F.lit(16 * max(known.count(), 1)))
    bits = known.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    holds = F.floor(byte / F.pow(F.lit(2), at % 8)) % 2 == 1
    some = docs.select("doc_id", "text", F.bitmap_bucket_number(place).alias("bucket")).join(F.broadcast(bits), "bucket").where(holds)
    return some.select("doc_id", "text").join(known.hint("merge"), "doc_id")


def op3_noisy_channel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score by a model of the labelled training fold; null texts count as empty, repeated rows get equal scores."""
    docs = documents(spark, sf_dir)
    model = fit(labelled_texts(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), "doc_id", "text", "toxic")
    out = score(docs, "text", [F.col("doc_id"), (residue("doc_id", 4) == 2).alias("held_out")], model)
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The rows of docs that score under the threshold, with their columns as they are, whatever their names.

    Null and empty texts have no evidence and stay; repeated rows go or stay together; without labels all stay that score
    under the threshold by a model that knows nothing (a half at no evidence would drop all, so then nothing is dropped).
    """
    model = fit(labelled_texts(docs, labels), "doc_id", "text", "toxic", s)
    if not model.texts:
        return docs
    names = docs.columns
    own = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    out = score(own, f"c{names.index('text')}", [F.col(c) for c in own.columns], model)
    return out.where(F.col("score") < THRESHOLD).select(*[F.col(c).alias(n) for c, n in zip(own.columns, names, strict=True)])
