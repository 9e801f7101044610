"""Language identification with bit-sliced Bloom filters of letter n-grams.

One filter row holds a bit for every language; a lookup ands the rows at an n-gram's hash positions and so
returns, at once, all languages that hold the n-gram. A text's hits are counted for each language, corrected
by that language's false-positive rate, and the largest share decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm._common import documents, materialise, residue, slices

UNKNOWN = "und"
_MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass(frozen=True)
class Settings:
    """n: letters of an n-gram. least_share: an n-gram enters a language's filter from this share of the language's n-grams on.

    contrast: and only if its share there is at least this part of its largest share in any language.
    bits: log2 of the filter's rows. hashes: positions of an n-gram. The filters hold at most 1 / least_share
    n-grams a language, whatever the corpus' size.
    """

    n: int = 3
    least_share: float = 2e-5
    contrast: float = 0.25
    bits: int = 21
    hashes: int = 3


def _letters() -> np.ndarray:
    """For each code point of all planes, its lower-case letter, or 0 where it is none."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


_LETTERS: np.ndarray | None = None


def grams(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts' letter n-grams as 64-bit hashes, the text each is from, and each text's letters.

    Words are runs of letters; an edge of a word counts as one more symbol.
    """
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = _letters()
    joined = "\n" + "\n".join((t or "").replace("\n", " ") for t in texts) + "\n"
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    line = np.cumsum(code == 10, dtype=np.int64) - 1
    letter = _LETTERS[code].astype(np.uint64)
    keep = np.ones(len(letter), bool)
    keep[1:] = (letter[1:] != 0) | (letter[:-1] != 0)  # runs of other characters to one edge
    letter, line = letter[keep], line[keep]
    letters = np.bincount(line[letter != 0], minlength=len(texts))[: len(texts)]
    if len(letter) < n:
        return np.empty(0, np.uint64), np.empty(0, np.int64), letters
    key = letter[: len(letter) - n + 1].copy()
    inner = np.ones(len(key), bool)
    for i in range(1, n):
        key = key * np.uint64(0x110000) + letter[i : len(letter) - n + 1 + i]
        if i < n - 1:
            inner &= letter[i : len(letter) - n + 1 + i] != 0  # an edge only at the ends
    mid = line[n // 2 : n // 2 + len(key)]
    key *= _MIX1
    key ^= key >> np.uint64(29)
    return key[inner], mid[inner], letters


def _positions(keys: np.ndarray, s: Settings) -> Iterator[np.ndarray]:
    for i in range(s.hashes):
        h = (keys ^ np.uint64(0xA5A5A5A5 * (i + 1))) * _MIX2
        yield (h >> np.uint64(64 - s.bits)).astype(np.int64)


@dataclass
class Model:
    languages: list[str]
    rows: np.ndarray  # for each row unsigned 64-bit numbers, a bit for every language
    rates: np.ndarray  # false-positive rate of each language's slice
    settings: Settings

    def masks(self, keys: np.ndarray) -> np.ndarray:
        """For each n-gram, the languages that hold it: bit j % 64 of number j // 64 stands for language j."""
        out = np.full((len(keys), self.rows.shape[1]), ~np.uint64(0))
        for at in _positions(keys, self.settings):
            out &= self.rows[at]
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; und and 0 where a text has no letter or nothing was learned.

        The score is the winner's part of all languages' corrected hits; ties go to the language that sorts first.
        """
        keys, of, letters = grams(texts, self.settings.n)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        masks, hits = self.masks(keys), np.zeros((len(texts), len(self.languages)))
        total = np.bincount(of, minlength=len(texts))[: len(texts)]
        for j in range(len(self.languages)):
            hits[:, j] = np.bincount(of[(masks[:, j // 64] >> np.uint64(j % 64) & np.uint64(1)).astype(bool)], minlength=len(texts))[: len(texts)]
        true = np.maximum(hits - total[:, None] * self.rates, 0) / (1 - self.rates)
        best, sums = true.argmax(axis=1), true.sum(axis=1)
        score = np.where(sums > 0, true[np.arange(len(texts)), best] / np.maximum(sums, 1e-12), 1 / len(self.languages))
        names = [self.languages[b] if n else UNKNOWN for b, n in zip(best.tolist(), letters.tolist(), strict=True)]
        return names, np.where(letters > 0, score, 0.0)


def fit(df: DataFrame, text: str, lang: str, s: Settings = Settings()) -> Model:
    """Count all n-grams of the rows with a language, and set the filters' bits.

    Rows without a language are left out; null and empty texts give a language no n-gram; repeated rows count as often as
    they occur; no rows give a model that knows no language. The languages' names reach the driver, and so do at most
    1 / least_share n-grams of each.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for name, (keys, n) in held.items():
                for at in range(0, len(keys), 50_000):
                    some = keys[at : at + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(some)), pa.array(some.view(np.int64)), pa.array(n[at : at + 50_000])], ["lang", "gram", "n"])
            held.clear()

        for batch in slices(batches):
            texts, names = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), object)
            keys, of, _ = grams(texts, s.n)
            for name in sorted(set(names)):
                found, n = np.unique(keys[names[of] == name], return_counts=True)
                if name in held:
                    both, back = np.unique(np.concatenate([held[name][0], found]), return_inverse=True)
                    found, n = both, np.bincount(back, weights=np.concatenate([held[name][1], n])).astype(np.int64)
                held[name] = [found, n.astype(np.int64)]
            if sum(len(k) for k, _ in held.values()) > 2_000_000:
                yield from out()
        yield from out()

    counts = df.where(F.col(lang).isNotNull()).select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(lang).cast("string").alias("lang")).mapInArrow(count, "lang string, gram long, n long")
    by = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    by = materialise(by, "grams")
    totals = {r["lang"]: r["n"] for r in by.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(totals)
    of = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(float(totals[k])))]) if languages else F.lit(None)
    frequent = by.withColumn("share", F.col("n") / of[F.col("lang")]).where(F.col("share") >= s.least_share).toPandas() if languages else None
    rows = np.zeros((1 << s.bits, max(1, -(-len(languages) // 64))), np.uint64)
    if languages:
        top = frequent.groupby("gram")["share"].transform("max")
        chosen = frequent[frequent["share"] >= s.contrast * top]
        for j, name in enumerate(languages):
            keys = chosen.loc[chosen["lang"] == name, "gram"].to_numpy(np.int64).view(np.uint64)
            for at in _positions(keys, s):
                rows[at, j // 64] |= np.uint64(1) << np.uint64(j % 64)  # equal positions get the same bit
    fill = np.array([((rows[:, j // 64] >> np.uint64(j % 64)) & np.uint64(1)).mean() for j in range(len(languages))])
    return Model(languages, rows, fill**s.hashes, s)


def predict(df: DataFrame, text: str, keep: list[Column], model: Model) -> DataFrame:
    """keep columns, lang_pred, score for every row, in place of keep columns of these names.

    Null, empty and letterless texts are ``und`` with score 0. Rows are judged one by one, so repeated rows get equal
    results and an empty table gives an empty one.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    kept = df.select(*keep).drop("lang_pred", "score")
    names = kept.columns
    kept = df.select(*[c for c, n in zip(keep, df.select(*keep).columns, strict=True) if n in names], F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches, column="__text"):
            lang, score = model.predict(batch.column(len(names)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*names, "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "__text")
    return kept.mapInArrow(run, f"{schema}, lang_pred string, score double")


def op6_bitmask_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language; null and letterless texts are und, repeated rows get equal results, documents without a language teach nothing."""
    docs = documents(spark, sf_dir)
    held = residue("doc_id", 4) == 2
    model = fit(docs.where(~held), "text", "lang")
    return predict(docs, "text", [F.col("doc_id"), held.alias("held_out")], model)
