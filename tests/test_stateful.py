"""The limiter with timers: batches in turn, late rows, keys that go, and the size of what is kept."""

import datetime as dt

from quire.streaming import stateful
from quire.streaming.runs import settings

START = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def test_idle_keys_go_and_late_rows_leave_no_trace(spark, tmp_path):
    schema = "key string, hit long, ts timestamp"
    batches = [
        [(f"k{i}", i, at(i % 30)) for i in range(300)] + [("a", 1000 + i, at(i)) for i in range(5)],
        [("a", 2000, at(20)), ("b", 2001, at(200)), ("a", 2002, None)],  # the watermark then stands at 190 minutes
        [("late", 3000, at(10)), ("a", 3001, at(30)), ("a", 3002, at(210)), ("b", 3003, at(211))],
        [("b", 4000, at(212))],
    ]
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{n}")
    out, sizes = [], []
    with settings(spark, **stateful.STATE):
        for n in range(len(batches)):
            source = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in") if n == len(batches) else spark.readStream.schema(schema).parquet(f"{tmp_path}/in/[0-{n}]")
            rows = stateful.limited(source.withWatermark("ts", "10 minutes"), "key", "hit", 3, 3600)
            q = rows.writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/state").foreachBatch(lambda df, _: out.extend(map(tuple, df.collect()))).trigger(availableNow=True).start()
            q.awaitTermination()
            sizes.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
    got = {h: ok for _, h, ok in out}
    assert len(out) == len(got) == 305 + 2 + 2 + 1  # no late row, no row without a time
    assert [got[1000 + i] for i in range(5)] == [True, True, True, False, False] and not got[2000]
    assert got[3002] and got[3003] and got[4000] is True
    assert not {3000, 3001, 2002} & set(got)
    assert sizes[0] >= 301 and sizes[1] <= 10, sizes  # a key has a few rows of state: its value and its timer
