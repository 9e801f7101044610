"""Contributions under moderation: a table that takes updates, read back after a series of them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.index import shared_root
from quire.plans.registry import query
from quire.sources.snapshots import SnapshotTable
from quire.tables import table

_ROUNDS = 3
_SCHEMA = "id long, uid long, status string, moderated_by long, moderated {0}"


def moderated(spark: SparkSession, sf_dir: str) -> SnapshotTable:
    """Contributions (clicks wait, views are private) and three rounds of decisions on them (purchases: from 50 on approved); each round's decisions are one change."""
    e = table(spark, sf_dir, "events")
    held = SnapshotTable(spark, f"{shared_root(spark)}/tables/{uuid.uuid4().hex}", "id", _SCHEMA.format(kind := e.schema["ts"].dataType.simpleString()))
    status = F.when(F.col("event_type") == "view", "private").otherwise("pending")
    held.insert(e.where("event_type IN ('click', 'view')").select(F.col("event_id").alias("id"), F.col("user_id").alias("uid"), status.alias("status"), F.lit(None).cast("long").alias("moderated_by"), F.lit(None).cast(kind).alias("moderated")), "contributions")
    # a decision's contribution lies some way before it
    made = e.where("event_type = 'purchase'").select((F.col("event_id") - F.col("user_id") % 40 - 1).alias("id"), F.when(F.col("value") >= 50, "approved").otherwise("rejected").alias("status"), F.col("user_id").alias("moderated_by"), F.col("ts").alias("moderated"), "event_id")
    for n in range(_ROUNDS):
        held.update(made.where(F.col("event_id") % _ROUNDS == n).withColumn("at", F.col("moderated")), ["at", "event_id"], f"round-{n}")
    return held


_SQL = f"""WITH c AS (SELECT event_id AS id, user_id AS uid, CASE WHEN event_type = 'view' THEN 'private' ELSE 'pending' END AS status FROM events WHERE event_type IN ('click', 'view')),
m AS (SELECT event_id - user_id % 40 - 1 AS id, arg_max({{'s': CASE WHEN value >= 50 THEN 'approved' ELSE 'rejected' END, 'u': user_id, 't': ts}}, (event_id % {_ROUNDS}, ts, event_id)) AS d FROM events WHERE event_type = 'purchase' GROUP BY 1)"""


@query(f"{_SQL} SELECT c.id, uid, coalesce(d.s, status) AS status, d.u AS moderated_by, d.t AS moderated FROM c LEFT JOIN m USING (id)")
def moderate_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All contributions after the decisions: the last round's last decision on one counts."""
    return moderated(spark, sf_dir).read()


@query(f"{_SQL} SELECT coalesce(d.s, status) AS status, count(*) AS n, count(d.u) AS decided, max(d.t) AS last FROM c LEFT JOIN m USING (id) GROUP BY 1")
def moderate_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contributions by status, from the table after its changes were written out."""
    held = moderated(spark, sf_dir)
    held.compact()
    return held.read().groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count("moderated_by").alias("decided"), F.max("moderated").alias("last"))
