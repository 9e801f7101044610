"""Text folding and n-grams as column expressions; Unicode compatibility folding is the one Python step."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

#: What the search and alignment folds drop, map and mark.
SEARCH_DROP = "«»؛،؟!?.,:;()[]{}\"'’‘—–-*/\\|_=+<>#%&@~`^$"
ALIGN_DROP = "«»؛،؟!?.,:;()[]{}\"'—–-*/\\|_=+<>#%&@~`^$"
MAP_FROM, MAP_TO = "يىكۀة", "ییکهه"
MAP_GONE = "ـ‏‎"
HARAKAT = "".join(map(chr, range(0x064B, 0x0653)))
EVAL_GONE = "ًٌٍَُِّْـ"
MARKS = r"\[(?:ILL|\?|BLANK PAGE|PLATE)\]"
TAG = r"^\s*\[[^\]]{0,40}\]\s*"
ZWNJ = "‌"


def _nfkc(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """A batch is taken in runs of few bytes, so that no more than one run of its texts is held as Python strings."""
    for batch in batches:
        start = size = 0
        runs = []
        for i, n in enumerate(pc.binary_length(batch).to_pylist()):
            if size and size + (n or 0) > 1_000_000:
                runs.append((start, i))
                start, size = i, 0
            size += n or 0
        for a, b in [*runs, (start, len(batch))]:
            yield pa.array([t if t is None or t.isascii() else unicodedata.normalize("NFKC", t) for t in batch.slice(a, b - a).to_pylist()], batch.type)


def nfkc(t: Column) -> Column:
    """Unicode compatibility composition; ASCII text passes at once."""
    return arrow_udf(_nfkc, "string")(t)


def _class(chars: str) -> str:
    return "[" + "".join("\\" + c if c in r"\[]^-&~" else c for c in chars) + "]"


def _fold(t: Column, drop: str, compose: bool) -> Column:
    t = F.regexp_replace(t, MARKS, " ")
    t = F.regexp_replace(t, r"\[([^\]]*)؟?\]", "$1")
    if compose:
        t = nfkc(t)
    t = F.translate(t, MAP_FROM + ZWNJ + MAP_GONE + HARAKAT, MAP_TO + " ")
    t = F.regexp_replace(F.replace(t, F.lit("ﻻ"), F.lit("لا")), _class(drop), " ")
    t = F.regexp_replace(t, r"(?U)\d+", " 0 ")
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


def fold_search(t: Column, compose: bool = True, lower: bool = False) -> Column:
    """The search fold. compose=False leaves out compatibility composition, for text that is stored composed; lower folds case."""
    t = F.coalesce(t, F.lit(""))
    return _fold(F.lower(t) if lower else t, SEARCH_DROP, compose)


def fold_tokens(t: Column, compose: bool = True) -> Column:
    """The alignment fold: like the search fold without a leading tag, as an array of tokens."""
    folded = _fold(F.regexp_replace(F.coalesce(t, F.lit("")), TAG, ""), ALIGN_DROP, compose)
    return F.filter(F.split(folded, " "), lambda w: F.length(w) > 0)


def fold_eval(t: Column, compose: bool = True) -> Column:
    """The evaluation fold: letter variants and marks only; punctuation, case and digits stay."""
    t = F.coalesce(t, F.lit(""))
    t = F.translate(nfkc(t) if compose else t, "يكۀأإآ" + EVAL_GONE, "یکهااا")
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


def tidy_edition(t: Column) -> Column:
    """Typographic clean-up of an edition's text: letter forms, invisible characters, blank runs and lines."""
    t = F.translate(F.coalesce(t, F.lit("")), "يىكـ​﻿", "ییک")
    t = F.replace(t, F.lit("ۀ"), F.lit("ه" + ZWNJ))
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return F.trim(F.array_join(F.transform(F.split(t, "\n"), lambda x: F.trim(x)), "\n"))


def char_ngrams(t: Column, n: int = 3, ordered: bool = False) -> Column:
    """All substrings of length n, blanks as underscores, in linear time; a shorter text is its own only n-gram.

    Cut into runs of n from each of the n first characters on, which is fast but out of order; ordered puts them
    in the text's order, for short texts.
    """

    def cut(u: Column) -> Column:
        if ordered:
            chars, many = F.split(u, ""), F.greatest(F.length(u) - n + 1, F.lit(0))
            out = F.slice(chars, 1, many)
            for i in range(1, n):
                out = F.zip_with(out, F.slice(chars, i + 1, many), lambda a, b: F.concat(a, b))
        else:
            runs = F.concat(*[F.split(F.substring(u, i + 1, 2**31 - 1), f"(?s)(?<=\\G.{{{n}}})") for i in range(n)])
            out = F.filter(runs, lambda x: F.length(x) == n)
        return F.when(F.length(u) < n, F.array(u)).otherwise(out)

    return let(F.translate(t, " ", "_"), cut)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often the body names it (Catalyst would put its expression in each place)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def token_ngrams(tokens: Column, longest: int) -> Column:
    """Runs of 1 to ``longest`` tokens, joined by blanks."""
    out = None
    for n in range(1, longest + 1):
        some = F.slice(tokens, 1, F.greatest(F.size(tokens) - n + 1, F.lit(0)))
        for i in range(1, n):
            some = F.zip_with(some, F.slice(tokens, i + 1, F.greatest(F.size(tokens) - n + 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
        out = some if out is None else F.concat(out, some)
    return out


def slug(t: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(t), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def xml_escape(t: Column, quote: bool = False) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *((('"', "&quot;"),) if quote else ())):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def full_lines(t: Column) -> Column:
    """Lines that aren't blank, as they are."""
    return F.filter(F.split(F.coalesce(t, F.lit("")), "\n"), lambda x: F.length(F.trim(x)) > 0)


def persian_digits(t: Column) -> Column:
    return F.translate(t, "0123456789", "۰۱۲۳۴۵۶۷۸۹")
