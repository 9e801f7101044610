"""Stored vectors in lists around centroids, searched exactly: a list is left out only where its bound proves that it holds nothing better."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.index import sorted_files
from quire.operators.search import dot

#: Lists at most; their centroids go to the driver and to every task.
LISTS = 4096


@dataclass(frozen=True)
class VectorIndex:
    """rows: (list, key, embedding); centroids: (list, centroid, radius, n) on the driver, a few thousand at most."""

    rows: DataFrame
    centroids: list
    n: int


def _nearest(store: DataFrame, key: str, centroids: np.ndarray) -> DataFrame:
    """(list, key, embedding, far): each vector with its nearest centroid and its distance from it."""
    sent = store.sparkSession.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), np.float64).reshape(batch.num_rows, -1)
            if not len(x):
                continue
            at = ((c * c).sum(axis=1)[None, :] - 2 * x @ c.T).argmin(axis=1)
            far = np.sqrt(((x - c[at]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), batch.column(0), batch.column(1), pa.array(far)], ["list", "key", "embedding", "far"])

    kinds = {f.name: f.dataType.simpleString() for f in store.schema}
    return store.select(F.col(key).alias("key"), "embedding").where("embedding IS NOT NULL").mapInArrow(assign, f"list int, key {kinds[key]}, embedding {kinds['embedding']}, far double")


def build(store: DataFrame, key: str, path: str, lists: int | None = None) -> None:
    """Write an index of store(key, embedding array). Centroids are means around vectors drawn by their key's hash; null vectors aren't in it."""
    spark = store.sparkSession
    n = store.where("embedding IS NOT NULL").count()
    lists = min(lists or max(1, math.isqrt(n)), LISTS)
    drawn = store.where("embedding IS NOT NULL").orderBy(F.xxhash64(key), key).limit(lists).select("embedding").collect()
    if drawn:
        seeds = np.array([r["embedding"] for r in drawn], np.float64)
        means = _nearest(store, key, seeds).groupBy("list").agg(*[F.avg(F.col("embedding")[i]).alias(f"m{i}") for i in range(seeds.shape[1])]).collect()
        seeds = np.array([r[1:] for r in means], np.float64)
        sorted_files(_nearest(store, key, seeds), "list", f"{path}/rows")
        rows = spark.read.parquet(f"{path}/rows")
        far = {r["list"]: (r["far"], r["n"]) for r in rows.groupBy("list").agg(F.max("far").alias("far"), F.count(F.lit(1)).alias("n")).collect()}
        made = [(i, [float(v) for v in c], *far[i]) for i, c in enumerate(seeds) if i in far]
    else:
        _nearest(store.limit(0), key, np.zeros((1, 1))).write.mode("overwrite").parquet(f"{path}/rows")
        made = []
    spark.createDataFrame(made, "list int, centroid array<double>, radius double, n long").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")


def open_index(spark, path: str) -> VectorIndex:  # noqa: ANN001
    centroids = spark.read.parquet(f"{path}/centroids").collect()
    return VectorIndex(spark.read.parquet(f"{path}/rows"), centroids, sum(r["n"] for r in centroids))


def search(index: VectorIndex, query: Sequence[float], k: int, first: int = 4) -> tuple[DataFrame, float]:
    """(key, score) of the best k by dot product, as a scan of all gives them, and the part of the vectors that was looked at.

    The ``first`` most promising lists give a k-th score; of the others only those are read that can hold as much: a vector's product is at most
    its centroid's and the query's length times the list's radius.
    """
    spark = index.rows.sparkSession
    q = F.array(*[F.lit(float(x)) for x in query])
    best = lambda lists: index.rows.where(F.col("list").isin(lists)).select("key", dot(F.col("embedding"), q).alias("score")).orderBy(F.desc("score"), "key").limit(k)
    if not index.centroids:
        return spark.createDataFrame([], f"key {dict(index.rows.dtypes)['key']}, score double"), 0.0
    v = np.array(query, np.float64)
    centre = {r["list"]: float(np.dot(v, r["centroid"])) for r in index.centroids}
    bound = {r["list"]: centre[r["list"]] + float(np.linalg.norm(v)) * r["radius"] for r in index.centroids}
    some = sorted(bound, key=lambda i: -centre[i])[:first]
    scores = [r["score"] for r in best(some).collect()]
    least = scores[-1] if len(scores) == k else -math.inf
    # rounding never leaves a list out
    read = some + [i for i in bound if i not in some and bound[i] >= least - 1e-9 * (1 + abs(least))]
    return best(read), sum(r["n"] for r in index.centroids if r["list"] in set(read)) / index.n
