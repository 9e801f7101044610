"""Silver labels from agreeing readers, evaluation, best windows, majority layouts and safe thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import metrics as M


def silver(reads: DataFrame, key: str, reader: str, text: str, order: str, agree: float = 0.8) -> DataFrame:
    """(key, outcome, ref, confidence, sources): a page is silver if its two most similar readings agree; their longer one is the label.

    Ties go to the pair that comes first by order, the label of equal length to the earlier reading. Others are told apart: no two
    readings, or disagreement. A page's readings are as many as there are readers, so they come together as one short list.
    """
    some = F.filter(F.array_sort(F.collect_list(F.struct(order, reader, text))), lambda x: F.length(F.trim(F.coalesce(x[text], F.lit("")))) > 0)
    pages = reads.groupBy(key).agg(some.alias("r"))
    i, j = F.col("p.i"), F.col("p.j")
    pair = F.explode_outer(F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(F.size("r") - 1, F.lit(0))), lambda a: F.transform(F.filter(F.sequence(F.lit(0), F.greatest(F.size("r") - 1, F.lit(0))), lambda b: b > a), lambda b: F.struct(a.alias("i"), b.alias("j"))))))
    met = pages.select(key, "r", pair.alias("p")).select(key, F.size("r").alias("n"), i.alias("i"), j.alias("j"), F.get("r", i).alias("x"), F.get("r", j).alias("y"))
    scored = met.withColumn("s", M.similarity(F.col(f"x.{text}"), F.col(f"y.{text}")))
    best = scored.groupBy(key).agg(F.max("n").alias("n"), F.max_by(F.struct("s", "x", "y"), F.struct("s", -F.col("i"), -F.col("j"))).alias("b"))
    a, b, s = F.col(f"b.x.{text}"), F.col(f"b.y.{text}"), F.col("b.s")
    agrees = (F.col("n") >= 2) & (s >= agree)
    return best.select(
        key, F.when(F.col("n") < 2, "insufficient_reads").when(agrees, "silver").otherwise("vendor_disagreement").alias("outcome"),
        F.when(agrees, F.when(F.length(a) >= F.length(b), a).otherwise(b)).alias("ref"), F.when(F.col("n") >= 2, s).alias("confidence"),
        F.when(F.col("n") >= 2, F.array(F.col(f"b.x.{reader}"), F.col(f"b.y.{reader}"))).alias("sources"),
    )


def bench_summary(rows: DataFrame, group: str, cer: str, failed: str) -> DataFrame:
    """(group, n, errors, cer_mean, cer_median): n counts the scored rows; means are null where there are none."""
    return rows.groupBy(group).agg(F.count(cer).alias("n"), F.count_if(failed).alias("errors"), F.avg(cer).alias("cer_mean"), F.median(cer).alias("cer_median"))


def bench_counts(rows: DataFrame, group: str, text: str, ref: str, failed: str) -> DataFrame:
    """(group, n, wer_mean, degenerate, truncated) of readings: failed rows count nowhere; a mean is null where no row has a reference."""
    good = rows.where(~F.coalesce(F.col(failed), F.lit(False)))
    t = F.coalesce(F.col(text), F.lit(""))
    marked = good.select(group, M.wer(t, F.col(ref)).alias("wer"), M.degenerate(t).alias("degenerate"), M.truncated(t).alias("truncated"))
    return marked.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg("wer").alias("wer_mean"), F.count_if("degenerate").alias("degenerate"), F.count_if("truncated").alias("truncated"))


def best_window(pred: Column, ref: Column) -> Column:
    """The least character error of the reference in windows 1.3 times as long, an eighth of it apart, 9 at most; null if either has under 40 characters."""
    n = F.length(ref)
    step = F.greatest(F.lit(1), F.floor(n / 8).cast("int"))
    last = F.greatest(F.lit(1), F.length(pred) - n) - 1
    starts = F.sequence(F.lit(0), F.greatest(last, F.lit(0)), step)
    each = F.transform(starts, lambda i: F.levenshtein(F.substring(pred, i + 1, F.floor(n * 13 / 10).cast("int")), ref) / n)
    return F.when((n >= 40) & (F.length(pred) >= 40), F.least(F.lit(9.0), F.array_min(each)))


def middle_of_majority(rows: DataFrame, key: str, kind: str, size: str, order: str) -> DataFrame:
    """(key, kind, size): the kind that most of a key's rows have (ties: seen first), and the middle size among those, the upper of two."""
    votes = rows.groupBy(key, kind).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"), F.array_sort(F.collect_list(size)).alias("sizes"))
    won = votes.groupBy(key).agg(F.max_by(F.struct(kind, "sizes"), F.struct("n", -F.col("first"))).alias("w"))
    return won.select(key, f"w.{kind}", F.get("w.sizes", F.floor(F.size("w.sizes") / 2).cast("int")).alias(size))


def safe_threshold(rows: DataFrame, blank: str, value: str) -> DataFrame:
    """(threshold, found, blanks): the smallest value, rounded to 5 places, under which most blank rows lie and no other row.

    Values under the least of the other rows are told by their counts, which are summed in order; there are at most 100,000 to a unit.
    """
    safe = rows.where(~F.col(blank)).agg(F.min(value).alias("safe"))
    low = rows.crossJoin(F.broadcast(safe)).where(F.round(value, 5) < F.col("safe"))
    counted = low.groupBy(F.round(value, 5).alias("t")).agg(F.count_if(F.col(blank) & (F.col(value) < F.round(value, 5))).alias("under"), F.count_if(F.col(blank) & (F.col(value) >= F.round(value, 5))).alias("at"))
    from pyspark.sql import Window

    before = Window.orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    found = counted.select("t", (F.col("under") + F.coalesce(F.sum(F.col("under") + F.col("at")).over(before), F.lit(0))).alias("found")).where("found > 0")
    best = found.agg(F.coalesce(F.max_by("t", F.struct("found", -F.col("t"))), F.lit(0.0)).alias("threshold"), F.coalesce(F.max("found"), F.lit(0)).alias("found"))
    return best.crossJoin(F.broadcast(rows.agg(F.count_if(blank).alias("blanks"))))


def to_reread(readings: DataFrame, limit: str = "MAX_TOKENS") -> DataFrame:
    """The pages of readings(page, finish) that ended at the token limit: they look clean but lack their end. In order, once each."""
    return readings.where(F.col("finish") == limit).select("page").distinct().orderBy("page")


def reread(readings: DataFrame, again: DataFrame, limit: str = "MAX_TOKENS") -> DataFrame:
    """readings with those of again in place of the ones that ended at the limit; other pages of again change nothing."""
    columns = [c for c in readings.columns if c != "page"]
    new = again.dropDuplicates(["page"]).select("page", F.struct(*columns).alias("__new"))
    met = readings.join(new, "page", "left").withColumn("__new", F.when(F.col("finish") == limit, F.col("__new")))
    return met.select("page", *[F.when(F.col("__new").isNotNull(), F.col("__new")[c]).otherwise(F.col(c)).alias(c) for c in columns])
