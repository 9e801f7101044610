"""Page layout, model replies, ink and geometry."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

REGIONS = 20
_REPLY = "columns_are string, regions array<struct<order:int,type:string,box:array<int>>>"


def reply(text: Column) -> Column:
    """(columns_are, regions) of a model's reply: the JSON from its first brace to its last; ``none`` and no regions where there is none.

    Regions need a box of four numbers; they come by order (missing ones last), 20 at most.
    """
    body = F.from_json(F.regexp_extract(F.coalesce(text, F.lit("")), r"(?s)\{.*\}", 0), _REPLY)
    kept = F.filter(F.coalesce(body["regions"], F.array().cast("array<struct<order:int,type:string,box:array<int>>>")), lambda r: F.size(r["box"]) == 4)
    ordered = F.transform(F.array_sort(F.transform(kept, lambda r, i: F.struct(F.coalesce(r["order"], F.lit(999)).alias("o"), i.alias("i"), r.alias("r")))), lambda x: x["r"])
    return F.struct(F.coalesce(body["columns_are"], F.lit("none")).alias("columns_are"), F.slice(ordered, 1, REGIONS).alias("regions"))


def routes_to_crops(columns_are: Column, regions: Column) -> Column:
    """Only sure prose columns, and more than one region, are read by crops."""
    return (columns_are == "independent_prose") & (regions > 1)


def verdict(text: Column) -> Column:
    """(verdict, confidence) of a judge's reply: an object, or a list's first object; uncertain and 0 where it says nothing."""
    kind = "verdict string, confidence double"
    t = F.trim(F.coalesce(text, F.lit("")))
    one = F.when(t.startswith("["), F.get(F.from_json(t, f"array<struct<verdict:string,confidence:double>>"), 0)).otherwise(F.from_json(t, kind))  # noqa: F541
    return F.struct(F.coalesce(one["verdict"], F.lit("uncertain")).alias("verdict"), F.when(one["verdict"].isNull(), 0.0).otherwise(F.coalesce(one["confidence"], F.lit(0.0))).alias("confidence"))


def is_blank(text: Column, least: int = 40) -> Column:
    """Whether a reading says that its page is blank, or has under 40 characters."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return t.contains("[BLANK PAGE]") | (F.length(t) < least)


def scaled(width: Column, height: Column, most: int) -> Column:
    """(width, height) shrunk so that the longer side is ``most`` at most; whole pixels, cut."""
    s = F.least(F.lit(1.0), F.lit(float(most)) / F.greatest(width, height))
    return F.struct((width * s).cast("int").alias("width"), (height * s).cast("int").alias("height"))


def _ink(images: pd.Series, widths: pd.Series) -> pd.Series:
    out = []
    for data, width in zip(images, widths, strict=True):
        if not data or not width:
            out.append(None)
            continue
        a = np.frombuffer(data, np.uint8)
        a = a[: len(a) // width * width].reshape(-1, width)
        h, w = int(a.shape[0] * 0.03), int(a.shape[1] * 0.03)
        inner = a[h : a.shape[0] - h, w : a.shape[1] - w]
        out.append(float((inner < 200).mean()) if inner.size else None)
    return pd.Series(out, dtype="float64")


def ink(image: Column, width: Column) -> Column:
    """Share of dark pixels (under 200) of a grey image's bytes, without its outer 3 %; null without pixels."""
    return pandas_udf(_ink, "double")(image, width)


def page_image(base: str, book: Column, page: Column) -> Column:
    return F.concat(F.lit(base.rstrip("/") + "/"), book, F.lit("/"), F.format_string("%05d", page), F.lit(".jpg"))


def backoff(attempt: Column, status: Column) -> Column:
    """Seconds to wait before another attempt (3, 6, 9 ...) after 401, 403, 429 and server errors; null where none is made, as after 400."""
    return F.when(status.isin(401, 403, 429) | (status >= 500), 3 * (attempt + 1))
