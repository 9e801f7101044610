"""Python steps over long texts: results of whole batches, from few bytes at a time."""

import inspect
import json
import unicodedata

import pyarrow as pa
from pyspark.sql import functions as F

from quire.functions import metrics as M
from quire.functions import text as T

TEXTS = [None, "", "plain", "ﬁne ﻻ é Å" * 60_000, "x" * 2_000_000, "ﷺ①", None]


def test_composition_takes_few_bytes_at_a_time(spark):
    want = [None if t is None else unicodedata.normalize("NFKC", t) for t in TEXTS]
    parts = list(T._nfkc(iter([pa.array(TEXTS), pa.array([], pa.string()), pa.array(["é"])])))
    assert [t for p in parts for t in p.to_pylist()] == [*want, "é"] and len(parts) > 4
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string").repartition(2).select("i", T.nfkc(F.col("t")).alias("t")).collect()
    assert [r["t"] for r in sorted(rows)] == want


def test_edits_are_applied_without_texts_in_python(spark):
    edits = [{"old": "aa", "new": "b"}, {"old": "b", "new": "a"}, 5, {"old": "é", "new": ""}, {"old": "", "new": "x"}, {"old": 1, "new": "y"}, {"old": "zz"}, {"old": "\ud800", "new": "q"}]
    payloads = [f"x {json.dumps(edits)} y", None, "none", "[1, 2", '{"old": "a"}', "[]"]
    rows = [(t, p) for t in (None, "", "aaa é zz", "plain") for p in payloads]
    got = spark.createDataFrame(rows, "t string, p string").select(M.apply_edits(F.col("t"), F.col("p")).alias("s")).select("s.*").collect()
    want = [("aa  zz", 3) if t == "aaa é zz" and p == payloads[0] else (t, 0) for t, p in rows]
    assert [tuple(r) for r in got] == want
    assert list(inspect.signature(M._edits).parameters) == ["payload"]
