"""Streams over the events table, run until its rows are used up, and the circuit breaker in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.plans.registry import ORACLES, query
from quire.streaming import limits, stateful
from quire.streaming.runs import finished
from quire.tables import table


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of one folder's files, with a time that watermarks take."""
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


_CALLS = """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t, event_type <> 'error' AND event_type <> 'view' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
s AS (SELECT user_id, event_id, k, true AS made, CASE WHEN ok THEN 0 ELSE 1 END AS failures, -1e18::DOUBLE AS until FROM e WHERE k = 1 UNION ALL
SELECT e.user_id, e.event_id, e.k, t >= until, CASE WHEN t < until THEN failures WHEN ok THEN 0 ELSE failures + 1 END, CASE WHEN t >= until AND NOT ok AND failures + 1 >= 3 THEN t + 86400 ELSE until END FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1)
SELECT user_id, event_id, made FROM s"""


def _calls(df: DataFrame) -> DataFrame:
    return df.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), (~F.col("event_type").isin("error", "view")).alias("ok"))


@query(_CALLS)
def breaker_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which calls a breaker of 3 failures and a day's pause lets through, for each user."""
    return limits.made_calls(_calls(table(spark, sf_dir, "events")), "user_id", "event_id", "ok", 3, 86_400)


@query(_CALLS)
def breaker_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = _calls(_stream(spark, sf_dir)).withWatermark("ts", "1 hour")
    return finished(limits.breaker_stream(calls, "user_id", "event_id", "ok", 3, 86_400, 10 * 86_400))


@query(ORACLES["rate_limit"])
def rate_limit_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limiter of 3 an hour and user over a stream."""
    return finished(limits.limited_stream(_stream(spark, sf_dir).withWatermark("ts", "1 hour"), "user_id", "event_id", 3, 3600))


@query(ORACLES["rate_limit"])
def rate_limit_timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same limiter, whose keys go by timers once their window has passed."""
    rows = _stream(spark, sf_dir).withWatermark("ts", "1 hour")
    return finished(stateful.limited(rows, "user_id", "event_id", 3, 3600), **stateful.STATE)


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of each user and kind that a stream brings."""
    e = _stream(spark, sf_dir).select("user_id", "event_type", "ts")
    return finished(limits.dedupe_stream(e, ["user_id", "event_type"], "ts", "3650 days")).select("user_id", "event_type")


@query(ORACLES["event_windows"])
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly windows of a stream with a watermark."""
    e = _stream(spark, sf_dir).withWatermark("ts", "1 day")
    w = e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return finished(w.select(F.col("w.start").alias("hour"), "event_type", "n", "total"), "complete").withColumn("hour", F.col("hour").cast("timestamp_ntz"))
