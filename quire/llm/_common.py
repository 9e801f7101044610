"""Shared plumbing of the training-data operators: the shared folder, tables written there, text batches."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only by a local master whose session names no checkpoint folder (tests, notebooks).
LOCAL_ONLY = "file:///tmp/checkpoints/quire"
ASCII_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. A cluster whose session names none is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (named or LOCAL_ONLY).rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/quire-{uuid.uuid4().hex}/{tag}"
    _written[path] = spark
    return path


def discard(path: str) -> None:
    """Remove what new_path() named, through Spark's own file systems."""
    spark = _written.pop(path, None)
    if spark is None:
        return
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path.rpartition("/")[0])
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


@atexit.register
def _discard_all() -> None:
    for path in list(_written):
        try:
            discard(path)
        except Exception:  # the JVM may be gone already
            return


def materialise(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage and survives lost executors. options: the writer's."""
    path = new_path(df.sparkSession, tag)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_bytes(column: str = "text") -> Column:
    """UTF-8 bytes of a text, null as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def residue(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo: the folds of the learning operators; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def slices(batches: Iterator[pa.RecordBatch], most_bytes: int = 4_000_000, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each has few bytes of text: Python memory stays flat whatever the texts' lengths.

    A single text beyond the bound makes a slice of its own.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.binary_length(batch.column(batch.schema.get_field_index(column))).to_pylist()
        start = size = 0
        for i, n in enumerate(lengths):
            if size and size + (n or 0) > most_bytes:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n or 0
        yield batch.slice(start)


def nth_smallest(df: DataFrame, column: str, n: int) -> float:
    """The value with n values before it in ascending order, exactly: counts of a thousand ranges narrow it down, pass by pass. No nulls."""
    v = F.col(column)
    lo, hi = df.agg(F.min(v), F.max(v)).first()
    while lo < hi:
        part = F.least(F.floor((v - lo) / (hi - lo) * 1000), F.lit(999))
        for r in df.where(v.between(lo, hi)).groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi")).orderBy("part").collect():
            if n < r["n"]:
                lo, hi = r["lo"], r["hi"]
                break
            n -= r["n"]
    return float(lo)


def logistic_sums(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> list[float]:
    """What a Newton step needs of points: sums of residuals and of curvature, each with x and without, and of x squared."""
    p = 1 / (1 + np.exp(-np.clip(w[0] * x + w[1], -30, 30)))
    h = p * (1 - p) + 1e-9
    return [float(a.sum()) for a in ((y - p) * x, y - p, h * x * x, h * x, h)]


def logistic_steps(sums: Callable[[np.ndarray], list[float]], ridge: float = 1e-2) -> tuple[float, float]:
    """Slope (not negative) and bias of a ridge logistic fit by Newton steps over logistic_sums() of all points."""
    w = np.zeros(2)
    for _ in range(30):
        gx, g, xx, x, one = sums(w)
        step = np.clip(np.linalg.solve([[xx + ridge, x], [x, one + ridge]], np.array([gx, g]) - ridge * w), -2, 2)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return max(float(w[0]), 0.0), float(w[1])


def fit_logistic(points: DataFrame, x: str, y: str) -> tuple[float, float]:
    """logistic_steps() of a written table's rows; each step is a pass over them, and only its five sums reach the driver."""

    def sums(w: np.ndarray) -> list[float]:
        v = F.col(x)
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), v * float(w[0]) + float(w[1])))))
        h = p * (1 - p) + 1e-9
        r = F.col(y) - p
        return [float(a or 0.0) for a in points.agg(F.sum(r * v), F.sum(r), F.sum(h * v * v), F.sum(h * v), F.sum(h)).first()]

    return logistic_steps(sums)
