"""Votes of rare tokens for places in an edition, and how often texts are folded for them."""

import random
from collections import Counter

from pyspark.sql import functions as F

from quire.operators import align
from quire.plans import document_queries as D


def _by_hand(words, places):
    hits = [(pos, at, tok) for pos, tok in enumerate(words) for at in places.get(tok, [])]
    best = lambda xs: min(Counter(xs).items(), key=lambda x: (-x[1], xs.index(x[0])))
    bucket, votes = best([(at - pos) // align.BUCKET for pos, at, _ in hits])
    inside = [h for h in hits if (h[1] - h[0]) // align.BUCKET == bucket]
    first = {}
    for pos, at, _ in inside:
        first.setdefault(pos, at)
    row, most = list(first.values()), []
    for i, x in enumerate(row):
        most.append(1 + max((most[j] for j in range(i) if row[j] < x), default=0))
    return bucket, votes, len({h[0] for h in hits}), max(0, best([at - pos for pos, at, _ in inside])[0]), len({h[2] for h in inside}), max(first) - min(first), max(most), len(first)


def test_anchors_by_hand(spark):
    r = random.Random(3)
    edition = [f"word{r.randrange(60)}" for _ in range(400)]
    pages = {k: [f"word{r.randrange(90)}" if r.random() < 0.4 else edition[(17 * k + i) % 400] for i in range(r.randint(1, 90))] for k in range(40)} | {99: ["none"]}
    places = {t: [i for i, x in enumerate(edition) if x == t] for t, n in Counter(edition).items() if n <= align.RARE}
    tokens = spark.createDataFrame([(k, i, t) for k, ws in pages.items() for i, t in enumerate(ws)], "k long, pos int, tok string").repartition(5)
    stream = spark.createDataFrame([(t, i) for i, t in enumerate(edition)], "tok string, pos long")
    want = {k: _by_hand(ws, places) for k, ws in pages.items() if any(t in places for t in ws)}
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    most = align.BROADCAST_ROWS
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # pages lie across batches
        for align.BROADCAST_ROWS in (most, 0):  # places sent to all tasks, or shuffled
            assert {r[0]: tuple(r)[1:] for r in align.anchors(tokens, stream, "k").collect()} == want
    finally:
        align.BROADCAST_ROWS = most
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_pages_are_folded_once(spark):
    plan = lambda kept: D._page_tokens(spark, "/root/testdata/sf0.001", kept=kept).agg(F.sum("pos"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan(False).count("BLANK PAGE") == 1
    assert plan(True).count("BLANK PAGE") == 0
