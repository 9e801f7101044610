"""Secret scans: fixed patterns, and a character convolutional network over every candidate in its context.

Candidates are the patterns' findings, values that follow a name and a sign of assignment, and other long runs of
key-like characters that hold digits among letters, capitals inside, or just many letters; also runs that reach beyond
a pattern's finding. The network sees a candidate's characters and those around it. It is trained on labelled findings:
generated ones of known kind, pattern findings of all real texts, and all their other candidates as harmless. Findings are
dealt into shares; in every round each share trains the network in a task of its own, and the mean of these networks begins
the next. Scores are calibrated on findings of texts it hasn't seen, and the threshold is the highest that keeps the wanted
recall there. Pattern findings stay whatever their score.
"""

from __future__ import annotations

import base64
import copy
import hashlib
import math
import random
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm._common import documents, fit_logistic, logistic_steps, logistic_sums, materialise, nth_smallest, slices

KINDS = ("assign", "access", "hex", "network")
_ASSIGN = re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_WORDS = ("password", "passwd", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_HEX_LONG = re.compile(r"[0-9a-f]{24,}")
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
_VALUE = re.compile(r"""[:=]\x20*["']?([A-Za-z0-9+/_.=-]{8,})""")
_DIGIT, _LETTER, _CHANGE = re.compile(r"[0-9]"), re.compile(r"[A-Za-z]"), re.compile(r"[a-z][A-Z]")
_BEYOND = 4

Span = tuple[int, int, int]  # start, end, kind


@dataclass(frozen=True)
class Settings:
    """body, before, after: characters of a candidate and of the text around it that the network sees; longer candidates are seen in windows, all of them.

    recall: of known findings that the threshold must keep. alarms: part of real texts' word-like candidates (letters of one case, perhaps
    after a capital) that may pass, for which those have a threshold of their own. examples: generated findings, which every
    share learns from besides its own. share: real texts' findings that one task learns from in a round, about; all are learned from.
    rounds: passes over the examples.
    """

    body: int = 48
    before: int = 24
    after: int = 8
    recall: float = 0.98
    alarms: float = 0.002
    examples: int = 6000
    share: int = 8000
    rounds: int = 6
    seed: int = 7


def base_spans(text: str) -> list[Span]:
    """The patterns' findings, leftmost and non-overlapping for each kind, in order of start and kind."""
    out: list[Span] = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), 2) for m in _HEX_LONG.finditer(text)]
    return sorted(out, key=lambda x: (x[0], x[2]))


def candidates(text: str, base: list[Span]) -> list[Span]:
    """Other candidates in order, none within another: runs of 12 key-like characters or more with digits among letters, of 16
    with a capital after a small letter or of letters alone, and values of 8 after a name; those within patterns' findings, but
    for 3 characters or fewer, are left out.
    """
    found = []
    for m in _RUN.finditer(text):
        a, b = m.span()
        if _LETTER.search(text, a, b) and (_DIGIT.search(text, a, b) or b - a >= 16 and (_CHANGE.search(text, a, b) or text[a:b].isalpha())):
            found.append((a, b))
    if "=" in text or ":" in text:
        for m in _VALUE.finditer(text):
            before = text[max(0, m.start() - 12) : m.start()].rstrip(" \"'")
            if before and (before[-1].isalnum() or before[-1] == "_"):
                b = m.end(1) - (m.group(1)[-1] == ".")
                if _LETTER.search(text, m.start(1), b):
                    found.append((m.start(1), b))
    if not found:
        return []
    covers: list[list[int]] = []  # patterns' findings, overlapping ones as one
    for a, b, _ in base:
        if covers and a <= covers[-1][1]:
            covers[-1][1] = max(covers[-1][1], b)
        else:
            covers.append([a, b])
    out, last, i = [], -1, 0
    for a, b in sorted(found, key=lambda x: (x[0], -x[1])):
        if b <= last:
            continue
        while i < len(covers) and covers[i][1] <= a:
            i += 1
        free, j = b - a, i
        while j < len(covers) and covers[j][0] < b:
            free -= min(b, covers[j][1]) - max(a, covers[j][0])
            j += 1
        if free == b - a or free >= _BEYOND:
            out.append((a, b, 3))
            last = b
    return out


_CLASSES = np.full(256, 39, np.int64)
for _i, _c in enumerate(string.ascii_lowercase + string.digits):
    _CLASSES[ord(_c)] = 1 + _i
for _c in string.ascii_uppercase:
    _CLASSES[ord(_c)] = 40 + ord(_c) - 65
for _c in " \t\n":
    _CLASSES[ord(_c)] = 37
for _c in "=:\"'":
    _CLASSES[ord(_c)] = 38
for _i, _c in enumerate("+/_-."):
    _CLASSES[ord(_c)] = 66 + _i
_SYMBOLS = 71


def _codes(text: str) -> np.ndarray:
    return _CLASSES[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 255)]


def windows(text: str, start: int, end: int, s: Settings) -> np.ndarray:
    """A candidate as rows of symbols: before, body, after; several rows where the candidate is longer than the body."""
    out = []
    for at in range(start, end, s.body):
        body = text[at : min(at + s.body, end)]
        before, after = text[max(0, at - s.before) : at], text[at + len(body) : at + len(body) + s.after]
        row = np.zeros(s.before + s.body + s.after, np.int64)
        if before:
            row[s.before - len(before) : s.before] = _codes(before)
        row[s.before : s.before + len(body)] = _codes(body)
        if after:
            row[s.before + s.body : s.before + s.body + len(after)] = _codes(after)
        out.append(row)
    return np.array(out)


class Network:
    """Symbol embedding, one convolution with ReLU, maximum and mean pooling, a logistic unit; plain numpy."""

    def __init__(self, seed: int, length: int, size: int = 8, width: int = 5, filters: int = 24) -> None:
        r = np.random.default_rng(seed)
        self.width, self.at = width, np.arange(length - width + 1)[:, None] + np.arange(width)
        self.p = {
            "embed": r.normal(0, 0.3, (_SYMBOLS, size)),
            "conv": r.normal(0, (2 / (width * size)) ** 0.5, (width * size, filters)),
            "conv_bias": np.zeros(filters),
            "out": r.normal(0, 0.1, 2 * filters),
            "out_bias": np.zeros(1),
        }
        self.means, self.squares = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))  # of gradients
        self.steps = 0
        self.curve = (1.0, 0.0)
        self.threshold = self.word_threshold = 0.5

    def vector(self) -> np.ndarray:
        """All that training changes, as one row of numbers."""
        return np.concatenate([d[k].ravel() for d in (self.p, self.means, self.squares) for k in self.p] + [[self.steps]])

    def load(self, vector: np.ndarray) -> None:
        at = 0
        for d in (self.p, self.means, self.squares):
            for k, a in d.items():
                d[k] = vector[at : at + a.size].reshape(a.shape)
                at += a.size
        self.steps = float(vector[at])

    def _forward(self, x: np.ndarray) -> tuple:
        e = self.p["embed"][x]  # n, length, size
        cols = e[:, self.at].reshape(len(x), len(self.at), -1)
        h = np.maximum(cols @ self.p["conv"] + self.p["conv_bias"], 0)
        top = h.argmax(axis=1)
        pooled = np.concatenate([np.take_along_axis(h, top[:, None], 1)[:, 0], h.mean(axis=1)], axis=1)
        return cols, h, top, pooled, pooled @ self.p["out"] + self.p["out_bias"]

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[i : i + 512])[-1] for i in range(0, len(x), 512)]) if len(x) else np.empty(0)

    def curved(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.curve[0] * raw + self.curve[1], -30, 30)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return self.curved(self.raw(x))

    def train(self, x: np.ndarray, y: np.ndarray, rounds: int, seed: int | list[int], batch: int = 64, rate: float = 5e-3) -> None:
        """Adam, which goes on from where earlier rounds ended."""
        r, m, v = np.random.default_rng(seed), self.means, self.squares
        for _ in range(rounds):
            order = r.permutation(len(x))
            for i in range(0, len(x), batch):
                some = order[i : i + batch]
                cols, h, top, pooled, z = self._forward(x[some])
                d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[some]) / len(some)
                f = self.p["conv"].shape[1]
                dp = d[:, None] * self.p["out"]
                dh = np.repeat(dp[:, None, f:] / h.shape[1], h.shape[1], axis=1)
                np.put_along_axis(dh, top[:, None], np.take_along_axis(dh, top[:, None], 1) + dp[:, None, :f], 1)
                dh *= h > 0
                dcols = (dh @ self.p["conv"].T).reshape(len(some), len(self.at), self.width, -1)
                de = np.zeros_like(self.p["embed"])
                np.add.at(de, x[some][:, self.at], dcols)
                g = {"embed": de, "conv": np.tensordot(cols, dh, ((0, 1), (0, 1))), "conv_bias": dh.sum((0, 1)), "out": pooled.T @ d, "out_bias": d.sum(keepdims=True)}
                self.steps += 1
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**self.steps)) / (np.sqrt(v[k] / (1 - 0.999**self.steps)) + 1e-8)


def generated(n: int, seed: int, filler: list[str]) -> list[tuple[str, int, int, int]]:
    """Findings of known kind as (text, start, end, label), half of each label."""
    r = random.Random(seed)
    pick = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    word = lambda: r.choice(filler)
    b62, hexes = string.ascii_letters + string.digits, "0123456789abcdef"

    def secret() -> str:
        return r.choice([
            lambda: pick(b62, r.randint(20, 64)), lambda: pick(hexes, r.randint(24, 64)), lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, 16),
            lambda: base64.b64encode(r.randbytes(r.randint(16, 48))).decode(), lambda: pick(b62 + "_-", r.randint(22, 48)),
            lambda: r.choice(["gh", "sk", "pk", "xox"]) + r.choice(["_", "-"]) + pick(b62, r.randint(24, 40)),
            lambda: pick(string.ascii_letters, r.randint(16, 40)), lambda: pick(string.ascii_lowercase, r.randint(18, 40)), lambda: pick(b62, r.randint(14, 20)),
            lambda: "-".join(pick(hexes, n) for n in (8, 4, 4, 4, 12)), lambda: pick(string.ascii_uppercase + string.digits, r.randint(16, 32)),
        ])()

    def assigned() -> tuple[str, str]:
        name = r.choice(["key", "auth", "pin", "pass", "credential", "private_key", "signature", "access_code", "bearer", "pwd"])
        return name + r.choice([" = ", ": ", "=", ' = "', ": '"]), pick(r.choice([b62, b62 + "+/_-", string.ascii_letters, hexes]), r.randint(10, 40))

    def plain() -> tuple[str, str]:
        name = r.choice(["key", "title", "name", "chapter", "note", "author", "page", "url", "see"])
        return name + r.choice([" = ", ": ", "=", ' = "', ": '"]), r.choice([lambda: "".join(word() for _ in range(3)), lambda: "_".join(word() for _ in range(3)), lambda: word() + word().capitalize() + word()])()

    def harmless() -> str:
        return r.choice([
            lambda: "_".join(word() for _ in range(r.randint(3, 5))) + f"_{r.randint(1, 99)}", lambda: "-".join(word() for _ in range(r.randint(3, 6))) + f"-{r.randint(1, 2030)}",
            lambda: "/".join(word() for _ in range(r.randint(3, 5))) + f"/{r.randint(1990, 2030)}/{r.randint(1, 12):02d}", lambda: f"{r.randint(1990, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}-{word()}-{word()}",
            lambda: word() + r.choice("=-_") * r.randint(14, 40) + str(r.randint(0, 9)), lambda: word() + r.choice(b62) * r.randint(18, 40) + str(r.randint(0, 9)),
            lambda: "".join(word() for _ in range(4)) + str(r.randint(1, 2030)), lambda: "".join(word().capitalize() for _ in range(4)) + str(r.randint(1, 99)),
            lambda: f"{r.randint(1000, 9999)}-{r.randint(1000, 9999)}-{r.randint(1000, 9999)}-{r.randint(1000, 9999)}-{word()}",
            lambda: "".join(word() for _ in range(r.randint(4, 8))), lambda: "".join(word() for _ in range(r.randint(4, 7))).capitalize(), lambda: "".join(word() for _ in range(5)).upper(),
        ])()

    out = []
    while len(out) < n:
        label = len(out) % 2
        if r.random() < 0.25:
            sign, body = assigned() if label else plain()
            left = " ".join(word() for _ in range(4)) + " " + sign
        else:
            body = secret() if label else harmless()
            left = " ".join(word() for _ in range(4)) + r.choice([" ", " ", "\n", " key = ", ": ", ' "', "="] if label else [" ", " ", "\n", " see ", ": ", " ("])
        if len(body) < 8:
            continue
        text = left + body + r.choice([" ", ". ", '" ', "\n"]) + word()
        out.append((text, len(left), len(left) + len(body), label))
    return out


_FILLER = ["the", "that", "und", "die", "que", "de", "with", "from", "report", "value", "chapter", "section", "data", "index", "name", "time", "other", "ition", "lehrung", "acion", "ement", "house", "river", "over"]


def _seen(findings: list[tuple], s: Settings) -> np.ndarray:
    """What the network sees of findings (text, start, end, ...), as rows."""
    return np.array([windows(t, a, b, s)[0] for t, a, b, *_ in findings], np.int64).reshape(len(findings), s.before + s.body + s.after)


def fit(labelled: DataFrame | None, s: Settings = Settings()) -> Network:
    """Train on generated findings and all of labelled_findings(), if any.

    A third of the generated findings, and all findings of a third of the texts, are kept for calibration and threshold.
    The driver holds the generated findings and a network for each share.
    """
    made = generated(s.examples, s.seed, _FILLER)
    x, y, kept = _seen(made, s), np.array([f[3] for f in made], float), np.arange(len(made)) % 3 == 2
    net = Network(s.seed, x.shape[1])
    found = materialise(labelled, "findings") if isinstance(labelled, DataFrame) else None
    n = found.where("h % 3 <> 2").count() if found is not None else 0
    if n:
        _train_shares(net, found.where("h % 3 <> 2"), math.ceil(n / s.share), x[~kept].astype(np.uint8), y[~kept], s)
    else:
        net.train(x[~kept], y[~kept], s.rounds, s.seed)
    raw = net.raw(x[kept])
    if found is None:
        net.curve = logistic_steps(lambda w: logistic_sums(raw, y[kept], w))
        sure = np.sort(raw[y[kept] == 1])
        net.threshold = net.word_threshold = float(net.curved(sure[int((1 - s.recall) * len(sure))])) if len(sure) else 0.5
        return net
    spark = found.sparkSession
    own = spark.createDataFrame([(float(z), int(label), True, False) for z, label in zip(raw, y[kept], strict=True)], _JUDGED)
    judged = materialise(own.union(_judged(found, net, s)), "judged")
    known = judged.where("kept")
    net.curve = fit_logistic(known, "z", "label")
    sure, words = known.where("label = 1"), judged.where("word")
    n, m = sure.count(), words.count()
    net.threshold = float(net.curved(nth_smallest(sure, "z", int((1 - s.recall) * n)))) if n else 0.5
    net.word_threshold = net.threshold
    if m:
        loud = net.curved(nth_smallest(words, "z", m - 1 - min(int(s.alarms * m), m - 1)))
        net.word_threshold = max(net.threshold, float(np.nextafter(loud, 1.0)))
    return net


def _train_shares(net: Network, found: DataFrame, shares: int, x: np.ndarray, y: np.ndarray, s: Settings) -> None:
    """s.rounds rounds over all findings: in each, every share and the generated findings train a copy of the network in one task, and the copies' mean is the network."""
    spark = found.sparkSession
    dealt = found.select(F.pmod(F.xxhash64("h", "t", "a", "b"), F.lit(shares)).alias("share"), "h", "t", "a", "b", "label").repartition(shares, "share")
    given = spark.sparkContext.broadcast((x, y))
    for r in range(s.rounds):
        now = spark.sparkContext.broadcast(net)

        def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:  # runs before the round ends
            rows = rows.sort_values(["h", "t", "a", "b", "label"])
            own = copy.deepcopy(now.value)
            x, y = given.value
            more = _seen(list(zip(rows["t"], rows["a"], rows["b"], strict=True)), s)
            own.train(np.concatenate([x.astype(np.int64), more]), np.concatenate([y, rows["label"].to_numpy(float)]), 1, [s.seed, r, key[0]])
            return pd.DataFrame({"share": [key[0]], "net": [own.vector()]})

        got = dealt.groupBy("share").applyInPandas(one, "share long, net array<double>").toPandas().sort_values("share")
        net.load(np.mean(np.stack(got["net"].to_list()), axis=0))


_JUDGED = "z double, label int, kept boolean, word boolean"


def _judged(found: DataFrame, net: Network, s: Settings) -> DataFrame:
    """The network's raw score of every finding; kept: it hasn't learned from its text; word: a harmless candidate like a word."""
    shared = found.sparkSession.sparkContext.broadcast(net)

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in pdfs:
            every = list(zip(rows["t"], rows["a"], rows["b"], rows["label"], strict=True))
            word = [not label and wordlike(t[a:b]) for t, a, b, label in every]
            yield pd.DataFrame({"z": shared.value.raw(_seen(every, s)), "label": rows["label"], "kept": rows["h"] % 3 == 2, "word": np.array(word, bool)})

    return found.mapInPandas(run, _JUDGED)


def wordlike(body: str) -> bool:
    """Letters of one case, perhaps after a capital: what words look like, and keys seldom."""
    return body.isalpha() and (body[1:].islower() or body.isupper())


def scan(text: str, net: Network, s: Settings = Settings()) -> tuple[list[Span], list[Span], list[float]]:
    """(base spans, all spans, the network's probability for each of all)."""
    base = base_spans(text)
    more = candidates(text, base)
    if not base and not more:
        return base, base, []
    every = base + more
    rows = [windows(text, a, b, s) for a, b, _ in every]
    p = net.probability(np.concatenate(rows))
    ends = np.cumsum([len(r) for r in rows])
    best = [float(p[e - len(r) : e].max()) for r, e in zip(rows, ends, strict=True)]
    kept = sorted(((sp, q) for sp, q in zip(every, best, strict=True) if sp[2] < 3 or q >= (net.word_threshold if wordlike(text[sp[0] : sp[1]]) else net.threshold)), key=lambda x: (x[0][0], x[0][2]))
    return base, [sp for sp, _ in kept], [q for _, q in kept]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def labelled_findings(docs: DataFrame, text: str, s: Settings = Settings()) -> DataFrame:
    """(h, t, a, b, label): pattern findings (label 1) and other candidates (label 0) of all texts, with as much text around them as the network sees.

    h tells the text; equal texts give their findings once.
    """
    texts = docs.where(F.col(text).isNotNull()).select(F.pmod(F.xxhash64(text), F.lit(1 << 30)).alias("h"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                base = base_spans(t)
                for a, b, kind in base + candidates(t, base):
                    start = max(0, a - s.before)
                    rows.append((h, t[start : a + s.body + s.after], a - start, min(b - start, a - start + s.body), int(kind < 3)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32()), strict=True)], ["h", "t", "a", "b", "label"])

    return texts.mapInArrow(run, "h long, t string, a int, b int, label int").distinct()


def _model(docs: DataFrame, text: str, s: Settings) -> Network:
    return fit(labelled_findings(docs, text, s), s)


def scan_table(df: DataFrame, text: str, keep: list[Column], net: Network, s: Settings = Settings()) -> DataFrame:
    """keep columns with counts and digests of the spans in every row, in place of keep columns of their names.

    Null texts count as empty and have no spans; rows are judged one by one, so repeated rows get equal results and an
    empty table gives an empty one.
    """
    shared = df.sparkSession.sparkContext.broadcast(net)
    added = ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "top_score")
    kept = df.select(*[c for c, n in zip(keep, df.select(*keep).columns, strict=True) if n not in added], F.coalesce(F.col(text), F.lit("")).alias("__text"))
    names = kept.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column="__text"):
            n, sha, every, top = ([], [], []), [], [], []
            for t in batch.column(len(names)).to_pylist():
                base, spans, p = scan(t, shared.value, s)
                for k in range(3):
                    n[k].append(sum(x[2] == k for x in base))
                sha.append(hashlib.sha256(joined(base).encode()).hexdigest())
                every.append(joined(spans))
                top.append(max(p, default=0.0))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(c, pa.int64()) for c in n), pa.array(sha), pa.array(every), pa.array(top, pa.float64())], [*names, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "top_score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "__text")
    return kept.mapInArrow(run, f"{schema}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, top_score double")


def op2_network_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's spans; null texts count as empty, and where nothing was found the network learns from generated findings alone."""
    docs = documents(spark, sf_dir)
    s = Settings()
    return scan_table(docs, "text", [F.col("doc_id")], _model(docs, "text", s), s)


def masked(text: str, spans: list[Span]) -> str:
    """The text with each run of overlapping spans replaced by its first kind's mark."""
    out, at = [], 0
    for a, b, k in spans:
        if a >= at:
            out += [text[at:a], f"[{KINDS[k]} removed]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask_secrets(docs: DataFrame, text: str = "text", size: str = "n_chars", s: Settings = Settings()) -> DataFrame:
    """docs with secrets masked in the text and the size column, if there is one, brought up to date. All rows stay; null texts stay null."""
    net = docs.sparkSession.sparkContext.broadcast(_model(docs, text, s))
    names = docs.columns
    at, sized = names.index(text), names.index(size) if size in names else None
    own = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column=f"c{at}"):
            columns = list(batch.columns)
            old = columns[at].to_pylist()
            new = [None if t is None else masked(t, scan(t, net.value, s)[1]) for t in old]
            columns[at] = pa.array(new, pa.string())
            if sized is not None:
                was = columns[sized].to_pylist()
                columns[sized] = pa.array([len(b) if a != b else n for a, b, n in zip(old, new, was, strict=True)], columns[sized].type)
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([batch.schema.field(i).with_type(c.type) for i, c in enumerate(columns)]))

    out = own.mapInArrow(run, own.schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
