"""Exact vector lists, the seam for models, kept list orders and rows in order."""

import random

from pyspark.sql import functions as F

from quire.operators import harvest, models, vectors
from quire.operators import search as S
from quire.sources.streams import ordered_rows


def test_vector_lists_give_what_a_scan_gives(spark, tmp_path):
    rnd = random.Random(7)
    near = [[rnd.gauss(0, 1) for _ in range(8)] for _ in range(12)]
    rows = [(i, [c + rnd.gauss(0, 0.05) for c in near[i % 12]]) for i in range(1500)] + [(2000, None), (2001, rows0 := [0.0] * 8), (2002, rows0)]
    store = spark.createDataFrame(rows, "vec long, embedding array<double>").repartition(3)
    vectors.build(store, "vec", f"file://{tmp_path}/v")
    index, shares = vectors.open_index(spark, f"file://{tmp_path}/v"), []
    for q in (near[0], near[5], [-x for x in near[3]], rows0):
        for k in (1, 25):
            got, share = vectors.search(index, q, k)
            want = S.search_vectors(store.where("embedding IS NOT NULL"), "vec", q, k)
            assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()]
            shares.append(share)
    assert min(shares) < 0.5 and index.n == 1502
    vectors.build(store.limit(0), "vec", f"file://{tmp_path}/none")
    assert vectors.search(vectors.open_index(spark, f"file://{tmp_path}/none"), near[0], 5)[0].count() == 0


def test_models_that_fail(spark):
    def picky(texts):
        if any("bad" in t for t in texts):
            raise ValueError("bad")
        return [[float(len(t)), 0.0] if t != "zero" else [0.0, 0.0] for t in texts]

    models.register("picky", picky)
    assert models.query_vector("picky", "abc") == [1.0, 0.0] and models.query_vector("picky", "x" * 9000) == [1.0, 0.0]
    assert models.query_vector("picky", "bad") is None and models.query_vector("none", "a") is None and models.query_vector("picky", "zero") is None
    df = spark.createDataFrame([(1, "a"), (2, "bad one"), (3, None), (4, ""), (5, "zero"), (6, "b")], "k int, t string").coalesce(1)
    assert {r["key"]: r["embedding"] for r in models.embedded(df, "k", "t", "picky").collect()} == {1: [1.0, 0.0], 2: None, 3: None, 4: None, 5: None, 6: [1.0, 0.0]}


def test_kept_order_gives_the_same_pages(spark, tmp_path):
    rows = [(f"b{i:04d}", ["all"] + (["even"] if i % 2 == 0 else []) if i % 7 else []) for i in range(345)]
    books = spark.createDataFrame(rows, "book string, sets array<string>").repartition(4)
    harvest.write_ranks(books, "book", "sets", f"{tmp_path}/r")
    for token, spec in (("", ""), ("100", ""), ("300", ""), ("", "even"), ("100:even", ""), ("400", ""), ("x", ""), ("", "none")):
        want, got = harvest.list_page(books, "book", "sets", token, spec), harvest.ranked_page(spark, f"{tmp_path}/r", token, spec)
        assert (want is None) == (got is None), (token, spec)
        if want:
            assert want[1] == got[1]
            assert sorted((r["nth"], r["book"]) for r in want[0].collect()) == sorted((r["nth"], r["book"]) for r in got[0].collect())


def test_numbers_of_a_long_list_have_no_gaps(spark, tmp_path):
    third = F.when(F.col("id") % 3 == 0, F.array(F.lit("all"), F.lit("third"))).otherwise(F.array(F.lit("all")))
    books = spark.range(0, 60_000, 1, 5).select(F.format_string("v%07d", F.col("id") * 7919 % 60_000).alias("book"), third.alias("sets"))
    harvest.write_ranks(books, "book", "sets", f"{tmp_path}/r")
    whole, kept = spark.read.parquet(f"{tmp_path}/r/all"), spark.read.parquet(f"{tmp_path}/r/sets")
    for name, rows in (("list", whole), ("paged", harvest.numbered(books, "book")), ("all", kept.where("spec = 'all'")), ("third", kept.where("spec = 'third'"))):
        got = [r[0] for r in rows.orderBy("book").select("nth").collect()]
        assert got == list(range(20_000 if name == "third" else 60_000)), name


def test_ordered_rows_come_a_range_at_a_time(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.range(10_000).select((F.col("id") * 7919 % 10_007).alias("k"), "id").repartition(5)
    assert [r["k"] for r in ordered_rows(df, "k", rows=500)] == sorted(r["k"] for r in df.collect())
    lazy = ordered_rows(df, "k", rows=500)
    marked = df.repartitionByRange(20, "k").sortWithinPartitions("k").mapInArrow(count, "k long, id long").toLocalIterator(prefetchPartitions=True)
    first = [next(marked)["k"] for _ in range(10)]
    assert first == [next(lazy)["k"] for _ in range(10)] == sorted(first)
    assert seen.value <= 4 * 10_000 // 20  # a range, the next one, and little more


def test_record_pages_of_one_file_are_dealt_over_the_cores(spark):
    from quire.plans import harvest_queries as Q

    for query in (Q.html_record, Q.html_record_titles):
        assert query(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism, query
