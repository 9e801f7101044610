"""Transcription metrics as column expressions, and the few over token sequences as pandas functions."""

from __future__ import annotations

import bisect
import json
import math
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from quire.functions.sequences import distance, matching_blocks
from quire.functions.text import full_lines

CUT = 8000


def _ratio(a: Column, b: Column) -> Column:
    return a.cast("double") / b


def cer(pred: Column, ref: Column) -> Column:
    """Character errors over the reference's length, of folded texts, both cut to 8000 characters; null without a reference."""
    p, r = F.left(F.coalesce(pred, F.lit("")), F.lit(CUT)), F.left(ref, F.lit(CUT))
    return F.when(F.length(ref) > 0, _ratio(F.levenshtein(p, r), F.length(r)))


def similarity(a: Column, b: Column) -> Column:
    """1 less the distance over the longer length; null where either is empty."""
    return F.when((F.length(a) > 0) & (F.length(b) > 0), 1 - _ratio(F.levenshtein(a, b), F.greatest(F.length(a), F.length(b))))


def _wer(pred: pd.Series, ref: pd.Series) -> pd.Series:
    return pd.Series([distance((p or "").split(), r.split()) / len(r.split()) if r and r.split() else None for p, r in zip(pred, ref, strict=True)], dtype="float64")


def degenerate(t: Column, least: int = 6) -> Column:
    """Whether long lines repeat: one four times or more, or over 30 % of them; fewer than four long lines never."""
    lines = F.filter(F.transform(F.split(F.coalesce(t, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: F.length(x) >= least)
    n, distinct = F.size(lines), F.size(F.array_distinct(lines))
    # Sorted lines put copies side by side: four equal ones are a line equal to the third after it.
    s = F.array_sort(lines)
    four = F.exists(F.zip_with(s, F.slice(s, 4, F.greatest(n, F.lit(1))), lambda a, b: F.coalesce(a == b, F.lit(False))), lambda x: x)
    return F.when(n < 4, F.lit(False)).otherwise(four | (_ratio(n - distinct, n) > 0.30))


def truncated(t: Column) -> Column:
    t = F.coalesce(t, F.lit(""))
    return t.contains("[TRUNCATED") | t.contains("[INCOMPLETE")


def line_stats(t: Column) -> Column:
    return F.struct(F.length(F.coalesce(t, F.lit(""))).alias("chars"), F.size(full_lines(t)).alias("lines"), degenerate(t).alias("degenerate"), truncated(t).alias("truncated"))


def _span(a: list[str], b: list[str], least: int = 2) -> tuple[int, int, int, int] | None:
    blocks = [m for m in matching_blocks(a, b) if m[2] >= least]
    if not blocks:
        return None
    return min(i for i, _, _ in blocks), max(i + n for i, _, n in blocks), min(j for _, j, _ in blocks), max(j + n for _, j, n in blocks)


SPAN_SCORE = "cer double, ref_recall double, yield double, span_coverage double, span_tokens long"


def _span_score(pred: pd.Series, ref: pd.Series) -> pd.DataFrame:
    out = []
    for p, r in zip(pred, ref, strict=True):
        a, b = (p or "").split(), (r or "").split()
        span = _span(a, b) if a and b else None
        if span is None or min(span[1] - span[0], span[3] - span[2]) < 60:
            out.append((None,) * 5)
            continue
        x, y = a[span[0] : span[1]], b[span[2] : span[3]]
        error = distance(x, y) / max(len(x), len(y))
        recall = len(y) / len(b)
        out.append((error, recall, recall * (1 - error), len(x) / len(a), len(x)))
    return pd.DataFrame(out, columns=["cer", "ref_recall", "yield", "span_coverage", "span_tokens"]).astype({"cer": "float64", "ref_recall": "float64", "yield": "float64", "span_coverage": "float64", "span_tokens": "Int64"})


DAMAGE = "correct_tokens long, false_corr long, false_corr_rate double, touched_wrong_rate double"


def _matched(a: list[str], b: list[str]) -> set[int]:
    return {i + k for i, _, n in matching_blocks(a, b) for k in range(n)}


def _damage(raw: pd.Series, corrected: pd.Series, edition: pd.Series) -> pd.DataFrame:
    out = []
    for r, c, e in zip(raw, corrected, edition, strict=True):
        a, b, w = (r or "").split(), (c or "").split(), (e or "").split()
        span = _span(a, w) if a and w else None
        right = {i for i in _matched(a, w) if span and span[0] <= i < span[1]}
        if not right:
            out.append((None,) * 4)
            continue
        kept = _matched(a, b)
        wrong = set(range(span[0], span[1])) - right
        false = right - kept
        out.append((len(right), len(false), len(false) / len(right), len(wrong - kept) / len(wrong) if wrong else None))
    return pd.DataFrame(out, columns=["correct_tokens", "false_corr", "false_corr_rate", "touched_wrong_rate"]).astype({"correct_tokens": "Int64", "false_corr": "Int64", "false_corr_rate": "float64", "touched_wrong_rate": "float64"})


def _edits(payload: pd.Series) -> pd.Series:
    """The payloads' edits that can change a text, as (old, new)."""
    out = []
    for body in payload:
        found = re.search(r"\[.*\]", body or "", re.S)
        try:
            edits = json.loads(found.group()) if found else []
        except ValueError:
            edits = []
        pairs = [(e.get("old"), e.get("new")) for e in edits if isinstance(e, dict)] if isinstance(edits, list) else []
        pairs = [(o, n) for o, n in pairs if isinstance(o, str) and isinstance(n, str) and o and o != n]
        # Half a surrogate pair is in no text, and no text can hold it.
        out.append([{"old": o, "new": n.encode("utf-8", "replace").decode()} for o, n in pairs if not re.search("[\ud800-\udfff]", o)])
    return pd.Series(out, dtype="object")


def longest_increasing(row: list) -> int:
    """Length of the longest strictly increasing subsequence."""
    tops: list = []
    for v in row:
        i = bisect.bisect_left(tops, v)
        tops[i : i + 1] = [v]
    return len(tops)


def _increasing_length(values: pd.Series) -> pd.Series:
    return values.map(lambda row: longest_increasing(row if row is not None else []))


def sign_test(n: Column, wins: Column) -> Column:
    """Two-sided binomial p of ``wins`` among n untied pairs: twice the smaller tail, 1 at most; 1 without pairs."""
    k = F.greatest(F.least(wins, n - wins), F.lit(0)).cast("int")
    # One pass: the tail's sum so far, and the log of the next term, C(n, i) / 2**n.
    start = F.struct(F.lit(0.0).alias("sum"), (-n * math.log(2)).cast("double").alias("term"))
    step = lambda s, i: F.struct((s["sum"] + F.exp(s["term"])).alias("sum"), (s["term"] + F.log((n - i).cast("double")) - F.log((i + 1).cast("double"))).alias("term"))
    tail = F.aggregate(F.sequence(F.lit(0), k), start, step, lambda s: s["sum"])
    return F.when(n > 0, F.least(F.lit(1.0), 2 * tail)).otherwise(1.0)


def output_tokens(candidates: Column, thoughts: Column, total: Column, prompt: Column) -> Column:
    """Billed output: the larger of what is reported and what the total leaves; missing counts are 0."""
    c, t, s, p = (F.coalesce(x, F.lit(0)) for x in (candidates, thoughts, total, prompt))
    return F.greatest(c + t, s - p, c)


def usd(prompt: Column, output: Column, price_in: Column, price_out: Column) -> Column:
    return (F.coalesce(prompt, F.lit(0)) * price_in + output * price_out) / 1e6


def wer(pred: Column, ref: Column) -> Column:
    """Token errors over the reference's tokens (folded texts); null without a reference."""
    return pandas_udf(_wer, "double")(pred, ref)


def span_score(pred: Column, ref: Column) -> Column:
    """Scores of two token strings over the hull of their matching blocks; null if either side of it has under 60 tokens."""
    return pandas_udf(_span_score, SPAN_SCORE)(pred, ref)


def damage(raw: Column, corrected: Column, edition: Column) -> Column:
    """What a correction did to tokens that were right, and to those that weren't, within the span that the edition covers."""
    return pandas_udf(_damage, DAMAGE)(raw, corrected, edition)


def apply_edits(raw: Column, payload: Column) -> Column:
    """Apply a model's list of {old, new} edits in turn; a payload that isn't one leaves the text and counts 0. Only payloads pass through Python."""
    start = F.struct(raw.alias("text"), F.lit(0).alias("applied"))

    def edit(s: Column, e: Column) -> Column:
        return F.when(F.contains(s["text"], e["old"]), F.struct(F.replace(s["text"], e["old"], e["new"]).alias("text"), (s["applied"] + 1).alias("applied"))).otherwise(s)

    return F.aggregate(pandas_udf(_edits, "array<struct<old: string, new: string>>")(payload), start, edit)


def increasing_length(values: Column) -> Column:
    """Length of the longest strictly increasing subsequence of each array."""
    return pandas_udf(_increasing_length, "int")(values)
