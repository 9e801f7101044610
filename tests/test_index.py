"""Postings counted by page against a slow count, and against those counted by a shuffle."""

import collections
import itertools

from pyspark.sql import functions as F

from quire.operators import search as S


def test_counted_postings(spark):
    rows = [(1, "abcabc abc"), (2, ""), (3, "a"), (4, "ab"), (5, "a b"), (6, "é😀x é😀x"), (7, "x" * 5000), (8, None), (9, "abcabc abc")]
    want = []
    for i, txt in rows:
        t = (txt or "").replace(" ", "_")
        grams = collections.Counter([t] if len(t) < 3 else [t[j : j + 3] for j in range(len(t) - 2)])
        want += [(g, i, n, max(1, len(t) - 2)) for g, n in grams.items()]
    df = spark.createDataFrame(rows, "id long, txt string").repartition(3)
    assert sorted(tuple(r) for r in S.counted(df).collect()) == sorted(want)
    plain = df.where("id NOT IN (6, 8)")
    assert sorted(tuple(r) for r in S.counted(plain).collect()) == sorted(tuple(r) for r in S.postings(plain).collect())
    assert S.counted(df.limit(0)).count() == 0


def test_stored_postings_are_blocks(spark, tmp_path):
    from quire.operators import index

    pages = spark.range(0, 600, 1, 2).select("id", F.lit("b").alias("book"), F.col("id").alias("page"), F.concat(F.lit("the same words "), F.col("id") % 7).alias("raw"))
    index.build(pages, f"{tmp_path}/i")
    stored = spark.read.parquet(f"{tmp_path}/i/postings")
    want = S.counted(S.index_pages(pages))
    assert stored.count() < want.count() / 20
    assert sorted(map(tuple, S.unblocked(stored).collect())) == sorted(map(tuple, want.collect()))
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/i/vocabulary").collect())) == sorted(map(tuple, S.vocabulary(want).collect()))
    plan = S.unblocked(stored).where("term = 'the'")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,the)" in plan.split("PushedFilters")[1]


def test_equal_pages_have_equal_scores_in_whatever_order_rows_arrive(spark):
    doc, tf = {"aaa": 3, "bbb": 17, "ccc": 101, "ddd": 7, "eee": 29}, {"aaa": 3, "bbb": 1, "ccc": 7, "ddd": 2, "eee": 5}
    rows = [(t, i, tf[t], 77) for i, order in enumerate(itertools.permutations(tf)) for t in order]
    scored = S.bm25(spark.createDataFrame(rows, "term string, id long, tf long, dl int").coalesce(1), list(tf), 1000, 100.3, doc).collect()
    assert len(scored) == 120 and len({r["score"] for r in scored}) == 1


def test_growing_index_searches_as_a_fresh_one(spark, tmp_path, monkeypatch):
    from quire.operators import growing
    from quire.operators.index import open_index

    monkeypatch.setattr(growing, "MERGE", 3)
    schema = "id long, book string, page long, raw string"
    page = lambda i, t: (i, f"b{i % 2}", i, f"the {t} of page {i} with gardens {'and water' * (i % 3)}")
    held = growing.GrowingIndex(spark, f"file://{tmp_path}/grown")
    assert held.open().n == 0 and S.search_trigram(held.open(), "gardens", 5).count() == 0
    now = {}
    for n, ids in enumerate([range(30), range(20, 40), [3, 5], [50], range(51, 60), [61]]):
        rows = [page(i, f"text{n}") for i in ids]
        version = held.add(spark.createDataFrame(rows, schema), f"step-{n}")
        assert held.add(spark.createDataFrame([page(99, "never")], schema), f"step-{n}") == version  # a replay
        now |= {r[0]: r for r in rows}
    held.remove(spark.createDataFrame([(4,), (50,)], "id long"), "gone")
    now = {i: r for i, r in now.items() if i not in (4, 50)}
    spark.createDataFrame(list(now.values()), schema).write.parquet(f"{tmp_path}/pages")
    fresh = open_index(spark.read.parquet(f"{tmp_path}/pages"), f"{tmp_path}/fresh")

    def same():
        grown = held.open()
        assert grown.n == fresh.n == len(now) and abs(grown.avgdl - fresh.avgdl) < 1e-9
        for text in ("gardens and water of page 5", "text2 of page", "zzz"):
            got, want = ([(r["id"], round(r["score"], 9), r["coverage"]) for r in S.search_trigram(i, text, 10).collect()] for i in (grown, fresh))
            assert got == want

    same()
    before = len(held.segments())
    while held.merge():
        assert len(held.segments()) < before
        before = len(held.segments())
        same()
