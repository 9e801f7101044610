"""Table loaders and the page-corpus view of a document table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages: book is the source, page the document's id, raw its text. Keys need no shuffle to make."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), F.col("source").alias("book"), F.col("doc_id").alias("page"), F.col("text").alias("raw"), F.col("n_chars").alias("nchars"))
