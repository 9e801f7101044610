"""Catalogue fields and page geometry as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import let


def years(t: Column) -> Column:
    """Gregorian (1600 to 2029) and Hijri (other, 1000 on) year ranges of a date line, kept apart and never converted.

    Years in brackets come first where a bracket holds a Gregorian one; else those outside; else all.
    """
    t = F.coalesce(t, F.lit(""))
    found = lambda x: F.transform(F.regexp_extract_all(x, F.lit(r"(?<!\d)(\d{3,4})(?!\d)"), 1), lambda y: y.cast("int"))
    inside = found(F.array_join(F.regexp_extract_all(t, F.lit(r"\[([^\]]*)\]"), 1), " "))
    outside = found(F.regexp_replace(t, r"\[[^\]]*\]", " "))
    gregorian = lambda a: F.filter(a, lambda y: y.between(1600, 2029))
    g = F.when(F.size(gregorian(inside)) > 0, gregorian(inside)).when(F.size(gregorian(outside)) > 0, gregorian(outside)).otherwise(gregorian(found(t)))
    h = F.filter(found(t), lambda y: (y >= 1000) & ~y.between(1600, 2029))
    return F.struct(F.array_min(g).alias("year_start"), F.array_max(g).alias("year_end"), F.array_min(h).alias("year_hijri_start"), F.array_max(h).alias("year_hijri_end"))


def date_text(lo: Column, hi: Column) -> Column:
    return F.when(lo.isNull(), "").when(hi.isNotNull() & (hi != lo), F.concat(lo.cast("string"), F.lit("–"), hi.cast("string"))).otherwise(lo.cast("string"))


def split_script(t: Column) -> Column:
    """(fa, en): the words of a value with and without Arabic script."""
    words = F.filter(F.split(F.coalesce(t, F.lit("")), r"\s+"), lambda w: F.length(w) > 0)
    arabic = lambda w: w.rlike("[؀-ۿ]")
    return F.struct(F.array_join(F.filter(words, arabic), " ").alias("fa"), F.array_join(F.filter(words, lambda w: ~arabic(w)), " ").alias("en"))


#: The blocks of Arabic script and its presentation forms.
ARABIC = "[\u0600-\u06ff\u0750-\u077f\ufb50-\ufdff\ufe70-\ufeff]"


def language_map(values: Column) -> Column:
    """Values by the language of their script: words in Arabic script under fa, the others under en, each value's together; a value without Arabic script stays whole.

    Null and empty values are left out. Where nothing is left the map says ``none`` with an empty list.
    """
    kept = F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda v: v.isNotNull() & (v != ""))
    words = lambda v, keep: F.array_join(F.filter(F.split(v, r"\s+"), lambda w: (w != "") & (w.rlike(ARABIC) if keep else ~w.rlike(ARABIC))), " ")
    full = lambda a: F.filter(a, lambda v: v != "")
    fa = full(F.transform(kept, lambda v: F.when(v.rlike(ARABIC), words(v, True)).otherwise("")))
    en = full(F.transform(kept, lambda v: F.when(v.rlike(ARABIC), words(v, False)).otherwise(v)))
    parts = F.filter(F.array(F.struct(F.lit("en").alias("key"), en.alias("value")), F.struct(F.lit("fa").alias("key"), fa.alias("value"))), lambda p: F.size(p["value"]) > 0)
    return F.map_from_entries(F.when(F.size(parts) > 0, parts).otherwise(F.array(F.struct(F.lit("none").alias("key"), kept.alias("value")))))


def reading_order(boxes: Column, tolerance: float) -> Column:
    """boxes: array of (x, y, id), x a box's centre. Columns by a walk in order of x, a new one when a box is over the
    tolerance from the column's first; then right to left, and down each column. Returns the ids in order.

    The walk keeps only the columns' first boxes, which are few; each box then finds its column among them.
    """
    ordered = F.array_sort(boxes)
    anchors = F.aggregate(ordered, F.array().cast("array<double>"), lambda s, b: F.when((F.size(s) > 0) & (F.abs(b["x"] - F.element_at(s, -1)) <= tolerance), s).otherwise(F.concat(s, F.array(b["x"]))))
    placed = lambda a: F.transform(ordered, lambda b: F.struct((-F.size(F.filter(a, lambda x: x <= b["x"]))).alias("c"), b["y"].alias("y"), b["id"].alias("id")))
    return let(anchors, lambda a: F.transform(F.array_sort(placed(a)), lambda x: x["id"]))


def crop(box: Column, width: Column, height: Column, pad: float = 0.015) -> Column:
    """(left, top, right, bottom) of a box [ymin, xmin, ymax, xmax] in thousandths, padded and clamped; null under 8 pixels a side."""
    at = lambda i, size, sign: F.greatest(F.lit(0), F.least(size, (F.element_at(box, i) / 1000.0 + sign * pad) * size)).cast("int")
    left, top, right, bottom = at(2, width, -1), at(1, height, -1), at(4, width, 1), at(3, height, 1)
    return F.when((right - left >= 8) & (bottom - top >= 8), F.struct(left.alias("left"), top.alias("top"), right.alias("right"), bottom.alias("bottom")))
