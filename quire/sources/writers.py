"""Writers: volume and corpus JSON lines, tables, resumable appends and idempotent batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_rows(pages: DataFrame, book: str | None = None) -> DataFrame:
    """One JSON object a page, in order of book and page; nulls are kept."""
    rows = pages.where(F.col("book") == book) if book else pages
    text = F.to_json(F.struct("book", "page", F.col("raw").alias("text")), {"ignoreNullFields": "false"})
    return rows.select("book", "page", text.alias("value")).orderBy("book", "page").select("value")


def volumes(pages: DataFrame, path: str) -> None:
    """A folder of JSON lines for each book."""
    pages.select("book", "page", F.col("raw").alias("text")).repartition("book").sortWithinPartitions("book", "page").write.option("ignoreNullFields", False).partitionBy("book").json(path)


def ordered_lines(df: DataFrame, path: str, *order: str) -> None:
    """JSON lines in order over the files' names, nulls kept, in place of what was there: ranges are sorted, so no task writes all."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def summary(df: DataFrame, path: str) -> None:
    """A table of one row, such as of aggregates, as one JSON document; nested structs stay nested."""
    df.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def work_table(df: DataFrame, path: str) -> None:
    df.write.csv(path, sep="\t", header=True)


def append_new(new: DataFrame, done: DataFrame, keys: list[str], path: str) -> None:
    """Append what isn't done yet, first row of each key; running it again adds nothing."""
    new.join(done.select(*keys), keys, "left_anti").dropDuplicates(keys).write.mode("append").option("ignoreNullFields", False).json(path)


def replace_batch(batch: DataFrame, batch_id: int, path: str) -> None:
    """A stream's batch under its own number, so that a retry takes the place of the first try."""
    batch.write.mode("overwrite").json(f"{path}/batch={batch_id}")
