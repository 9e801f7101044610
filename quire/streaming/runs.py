"""Run a stream over what its source holds now, and read its result."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from quire.operators.index import shared_root


@contextmanager
def settings(spark: SparkSession, **conf: str) -> Iterator[None]:
    """The session with other settings for a while."""
    was = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def finished(stream: DataFrame, mode: str = "append", **conf: str) -> DataFrame:
    """All that a stream gives until its source is used up, from the shared folder. complete: its last table. conf: settings that it runs under."""
    spark = stream.sparkSession
    path = f"{shared_root(spark)}/streams/{uuid.uuid4().hex}"
    with settings(spark, **conf):
        writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True)
        if mode == "append":
            query = writer.format("parquet").option("path", f"{path}/out").start()
        else:
            query = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{path}/out")).start()
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")
