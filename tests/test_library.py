"""Readers, folds, metrics and stateful parts on small hand-made inputs; queries against their SQL on the smallest tables."""

import json
import math
import zipfile

import pytest
from pyspark.sql import functions as F

from quire.functions import metrics as M
from quire.functions import text as T
from quire.sources import readers, writers
from quire.streaming.limits import Breaker, admit


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


def test_search_fold(spark):
    assert one(spark, T.fold_search(F.col("t")), t="[BLANK PAGE] كتابـي‌ها [word?] ۱۲۳ «a»") == "کتابی ها word 0 a"
    again = one(spark, T.fold_search(F.col("t")), t="کتابی ها word 0 a")
    assert again == "کتابی ها word 0 a"
    assert one(spark, T.fold_eval(F.col("t")), t=" أب\n ۀ, ") == "اب ه,"
    assert one(spark, T.fold_tokens(F.col("t")), t="[Persian] a b") == ["a", "b"]


def test_ngrams(spark):
    assert sorted(one(spark, T.char_ngrams(F.col("t")), t="ab cd")) == ["_cd", "ab_", "b_c"]
    assert one(spark, T.char_ngrams(F.col("t"), ordered=True), t="ab cd") == ["ab_", "b_c", "_cd"] and one(spark, T.char_ngrams(F.col("t")), t="ab") == ["ab"]
    assert one(spark, T.token_ngrams(F.split("t", " "), 2), t="a b c") == ["a", "b", "c", "a b", "b c"]


def test_metrics(spark):
    assert one(spark, M.cer(F.col("a"), F.col("b")), a="abd", b="abc") == pytest.approx(1 / 3) and one(spark, M.cer(F.col("a"), F.col("b")), a="x", b="") is None
    assert one(spark, M.degenerate(F.col("t")), t="same long line\n" * 4) and not one(spark, M.degenerate(F.col("t")), t="one line here\nother line\nthird line\nfourth line")
    assert one(spark, M.apply_edits(F.col("a"), F.col("b"))["text"], a="a b", b='x [{"old":"a","new":"c"}] y') == "c b"
    assert one(spark, M.increasing_length(F.array(F.lit(3), F.lit(1), F.lit(2), F.lit(2))), t="") == 2


@pytest.mark.parametrize(("n", "w"), [(0, 0), (10, 10), (10, 0), (10, 5), (96, 60)])
def test_sign_test_has_two_sides(spark, n, w):
    want = min(1.0, 2 * sum(math.comb(n, i) for i in range(min(w, n - w) + 1)) / 2**n) if n else 1.0
    assert spark.range(1).select(M.sign_test(F.lit(n), F.lit(w)).alias("p")).first()["p"] == pytest.approx(want)


def test_sign_test_adds_the_whole_of_a_long_tail(spark):
    n, w = 80_486, 39_936
    want = 2 * math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2)) for i in range(w + 1))
    assert spark.range(1).select(M.sign_test(F.lit(n), F.lit(w)).alias("p")).first()["p"] == pytest.approx(want, abs=1e-7)


def test_limiter_and_breaker():
    assert admit([0, 1, 2, 3, 11], [], 2, 10)[0] == [True, True, False, False, True]
    b = Breaker()
    for t in range(3):
        b.record(False, t)
    assert not b.allows(10) and b.allows(302)
    b.record(False, 302)
    assert not b.allows(303)


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"key": "x", "n": 1}\nnot json\n{"n": 2}\n')
    assert readers.json_lines(spark, str(tmp_path / "a.jsonl"), "key string, n int", "key").count() == 1
    assert readers.json_document(spark, str(tmp_path / "none.json"), "a int").count() == 0
    (tmp_path / "w.tsv").write_text("id\timages\nb1\t7\nb2\tx\n")
    assert [tuple(r) for r in readers.work_list(spark, str(tmp_path / "w.tsv")).orderBy("book").collect()] == [("b1", 7), ("b2", 0)]
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("p1.xml", '<String CONTENT="a b"/><String CONTENT="c"/>')
        z.writestr("p1.png", "x")
    assert readers.zip_members(spark, str(tmp_path / "z.zip"), r"\.xml$").select(readers.alto_text(F.col("content").cast("string")).alias("t")).first()["t"] == "a b c"
    row = {"request": {"contents": [{"parts": [{"file_data": {"file_uri": "g/b/00012.jpg"}}]}]}, "response": {"candidates": [{"content": {"parts": [{"text": "T"}]}}], "usageMetadata": {"promptTokenCount": 5, "totalTokenCount": 9}}, "status": ""}
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "s.jsonl").write_text(json.dumps(row) + "\n{}\n")
    got = readers.predictions(spark, str(tmp_path / "p"), spark.createDataFrame([("g/b/00012.jpg", "B")], "uri string, book string")).collect()
    assert [(r["book"], r["page"], r["text"], r["tok_out"]) for r in got] == [("B", 12, "T", 4)]
    pages = spark.createDataFrame([("b", 2, None), ("b", 1, "x")], "book string, page int, raw string")
    assert [json.loads(r["value"])["page"] for r in writers.json_rows(pages).collect()] == [1, 2]
    for _ in range(2):
        done = spark.read.schema("book string, page int").json(str(tmp_path / "out")) if (tmp_path / "out").exists() else pages.limit(0)
        writers.append_new(pages, done, ["book", "page"], str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_nested_sources(spark, tmp_path):
    for folder, stem, body in (("a", "p2", "x" * 20), ("a", "p1", "y" * 20), ("a", "p3", "short"), ("b", "q1", "z" * 20)):
        (tmp_path / "g" / folder).mkdir(parents=True, exist_ok=True)
        (tmp_path / "g" / folder / f"{stem}.gt.txt").write_text(body)
        if stem != "q1":
            (tmp_path / "g" / folder / f"{stem}.png").write_text("i")
    got = readers.paired_texts(spark, str(tmp_path / "g"), each=1).collect()
    assert [(r["folder"], r["stem"]) for r in got] == [("a", "p1")]
    inner = tmp_path / "D1.zip"
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("xml/p7.xml", '<String CONTENT="' + "w" * 70 + '"/>')
        z.writestr("img/p7_scan.jpg", "i")
        z.writestr("img/p8.jpg", "i")
    (tmp_path / "arch").mkdir()
    with zipfile.ZipFile(tmp_path / "arch" / "all.zip", "w") as z:
        z.writestr("D1.zip", inner.read_bytes())
    (tmp_path / "m.tsv").write_text("doc\tpage\tlanguage\tstyle\tcount\nD1\tp7\tPersian\tNastaliq\t3\nD1\tp8\tPersian\tNastaliq\t0\nD1\tp7\tArabic\tNaskh\t3\n")
    got = readers.zipped_pages(spark, str(tmp_path / "m.tsv"), str(tmp_path / "arch"), "Persian", "nastaliq").collect()
    assert [(r["doc"], r["page"], len(r["ref"]), r["image"]) for r in got] == [("D1", "p7", 70, "img/p7_scan.jpg")]
    (tmp_path / "b.jsonl").write_text("\n".join(['{"book":"x","page":1,"gold":"' + "g" * 90 + '"}', "broken", '{"book":"x","page":1,"gold":"' + "h" * 90 + '"}', '{"book":"x","page":2,"gold":null}', '{"book":"y","page":1,"gold":"' + "k" * 80 + '"}']))
    assert [(r["book"], r["page"], r["gold"][0]) for r in readers.gold_pages(spark, str(tmp_path / "b.jsonl")).collect()] == [("x", 1, "g"), ("y", 1, "k")]
    assert one(spark, readers.directory_links(F.col("t")), t='<a href="adl2/">a</a><a href="adl10/">b</a><a href="adl2/">c</a><a href="x.html">') == ["adl10", "adl2"]
    row = "\t".join(["7", "Herat", "Herat", "هرات,Hirat", "34.3", "62.2", "P", "PPLA", "AF", "", "", "", "", "", "400000"])
    (tmp_path / "geo.txt").write_text(row + "\n" + row.replace("PPLA", "PPL").replace("400000", "5") + "\n" + row.replace("AF", "IR").replace("Herat", "Tehran") + "\n")
    places = readers.gazetteer(spark, str(tmp_path / "geo.txt"), {"IR": ["Tehran"]}, "AF", ["PPLA"]).collect()
    assert sorted((r["name"], r["country"], tuple(r["variants"])) for r in places) == [("Herat", "AF", ("هرات",)), ("Tehran", "IR", ("هرات",))]
    with pytest.raises(Exception):  # noqa: B017 - Spark's own error
        readers.json_lines(spark, str(tmp_path / "b.jsonl"), "book string, page int", strict=True).collect()


def test_sinks(spark, tmp_path):
    pages = spark.createDataFrame([("b", 2, "two"), ("b", 1, None), ("a", 1, "x")], "book string, page int, raw string")
    writers.volumes(pages, str(tmp_path / "v"))
    assert sorted(p.name for p in (tmp_path / "v").iterdir() if p.is_dir()) == ["book=a", "book=b"]
    writers.ordered_lines(pages, str(tmp_path / "o"), "book", "page")
    lines = [x for f in sorted((tmp_path / "o").glob("part-*")) for x in f.read_text().splitlines()]
    assert [(json.loads(x)["book"], json.loads(x)["page"]) for x in lines] == [("a", 1), ("b", 1), ("b", 2)] and '"raw":null' in lines[1]
    writers.summary(pages.agg(F.struct(F.count(F.lit(1)).alias("n")).alias("s")), str(tmp_path / "s"))
    assert json.loads(next((tmp_path / "s").glob("part-*")).read_text()) == {"s": {"n": 3}}
    writers.work_table(pages.select("book", "page"), str(tmp_path / "t"))
    assert spark.read.csv(str(tmp_path / "t"), sep="\t", header=True).count() == 3
    for raw in ("first", "again"):
        writers.replace_batch(pages.withColumn("raw", F.lit(raw)), 4, str(tmp_path / "r"))
    assert {r["raw"] for r in spark.read.json(str(tmp_path / "r")).collect()} == {"again"}


def test_record_pages(spark):
    page = """<table><tr><td class="label">Title:</td><td class="value">Sir&#257;j <b>x</b></td></tr><tr><td></td><td class="value arabic">سراج‏</td></tr><tr><td></td><td class="value">Second</td></tr>
    <tr><td class="label">Contributors</td><td>A<br/>B</td></tr><tr><td></td><td class="other">no</td></tr><tr><td class="label">Downloadable PDF</td><td><a href="/f.pdf">get</a></td></tr><tr><td class="label">New Field!</td><td>v</td></tr><tr><td class="label">Abstract</td><td> <br> </td></tr></table>"""
    from quire.functions.records import text_of, with_record

    pages = [page, "<p>no table</p>", None, '<table><tr><td class="label">Other titles</td><td>A<br>B</td></tr><tr><td class="label">Other titles</td><td>C</td></tr><tr><td class="label">کتاب</td><td>x</td></tr><tr><td> </td><td class="value">D &amp; E</td></tr>' + "<tr><td>" + "<i>z</i>" * 20_000 + "</td></tr></table>"]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "page int, html string").withColumn("__r", F.lit(1))
    got = [r["record"] for r in with_record(df, "html").orderBy("page").collect()]
    assert got[0] == {"title": ["Sirāj x"], "title_original": ["سراج"], "title_alt": ["Second"], "contributors": ["A", "B"], "pdf": ["/f.pdf"], "new_field": ["v"]}
    assert got[1:] == [{}, {}, {"other_titles": ["A", "B", "C", "D & E"]}]
    assert [r[0] for r in df.orderBy("page").select(text_of(F.col("html"))).limit(3).collect()][1:] == ["no table", None]


def test_geometry_and_replies(spark):
    from quire.functions import catalogue as C
    from quire.functions import layout as L

    row = spark.range(1).select(
        L.reply(F.lit('x {"columns_are":"none","regions":[{"box":[1,2,3]},{"order":2,"box":[1,2,3,4]},{"box":[5,6,7,8]},{"order":1,"box":[9,9,9,9]}]} y')).alias("r"), L.reply(F.lit("nothing")).alias("e"),
        L.verdict(F.lit('[{"verdict":"same","confidence":0.9}]')).alias("v"), L.verdict(F.lit("{}")).alias("u"), L.scaled(F.lit(4000), F.lit(1000), 2500).alias("s"), L.backoff(F.lit(1), F.lit(503)).alias("b"), L.backoff(F.lit(1), F.lit(400)).alias("n"),
        C.crop(F.array(*map(F.lit, (100, 200, 300, 400))), F.lit(1000), F.lit(2000)).alias("c"), C.crop(F.array(*map(F.lit, (0, 0, 0, 0))), F.lit(10), F.lit(10)).alias("small"),
        L.ink(F.lit(bytes([255] * 5000 + [0] * 5000)), F.lit(100)).alias("ink"), C.reading_order(F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"), F.lit(i).cast("long").alias("id")) for i, (x, y) in enumerate([(10, 5), (30, 1), (50, 0), (200, 9), (190, 2)])]), 30.0).alias("o"),
    ).first()
    assert [r["box"] for r in row["r"]["regions"]] == [[9, 9, 9, 9], [1, 2, 3, 4], [5, 6, 7, 8]] and tuple(row["e"]) == ("none", [])
    assert tuple(row["v"]) == ("same", 0.9) and tuple(row["u"]) == ("uncertain", 0.0) and tuple(row["s"]) == (2500, 625) and row["b"] == 6 and row["n"] is None
    assert tuple(row["c"]) == (185, 170, 415, 630) and row["small"] is None and row["ink"] == pytest.approx(0.5)
    assert row["o"] == [4, 3, 2, 1, 0]  # columns by their first box: (10, 30), (50), (190, 200)
    assert one(spark, T.tidy_edition(F.col("t")), t=" كـ  a\n\n\n\n b ") == "ک a\n\nb"


def slow_blocks(a, b):
    """Matching blocks by the definition: the longest match, the earliest in a and then in b, and the same on both sides of it."""
    best = max(((k, -i, -j) for i in range(len(a)) for j in range(len(b)) for k in [next(n for n in range(min(len(a) - i, len(b) - j) + 1) if n == min(len(a) - i, len(b) - j) or a[i + n] != b[j + n])] if k), default=None)
    if best is None:
        return []
    k, i, j = best[0], -best[1], -best[2]
    return [*slow_blocks(a[:i], b[:j]), (i, j, k), *[(i + k + x, j + k + y, n) for x, y, n in slow_blocks(a[i + k :], b[j + k :])]]


def test_spans_and_damage_by_definition(spark):
    import random

    r = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    for _ in range(3):
        ref = [r.choice(words) for _ in range(90)]
        pred = [w if r.random() > 0.1 else "x" for w in ref[8:]] + ["tail"] * 5
        fixed = [w if r.random() > 0.05 else "y" for w in pred]
        blocks = [b for b in slow_blocks(pred, ref) if b[2] >= 2]
        a0, a1, b0, b1 = min(i for i, _, _ in blocks), max(i + n for i, _, n in blocks), min(j for _, j, _ in blocks), max(j + n for _, j, n in blocks)
        row = spark.createDataFrame([(" ".join(pred), " ".join(ref), " ".join(fixed))], "p string, r string, f string").select(M.span_score(F.col("p"), F.col("r")).alias("s"), M.damage(F.col("p"), F.col("f"), F.col("r")).alias("d")).first()
        x, y = pred[a0:a1], ref[b0:b1]
        table = [list(range(len(y) + 1))] + [[i + 1] + [0] * len(y) for i in range(len(x))]
        for i in range(len(x)):
            for j in range(len(y)):
                table[i + 1][j + 1] = min(table[i][j + 1] + 1, table[i + 1][j] + 1, table[i][j] + (x[i] != y[j]))
        error = table[-1][-1] / max(len(x), len(y))
        assert row["s"]["cer"] == pytest.approx(error) and row["s"]["ref_recall"] == pytest.approx(len(y) / len(ref)) and row["s"]["yield"] == pytest.approx(len(y) / len(ref) * (1 - error)) and row["s"]["span_tokens"] == len(x)
        right = {i + k for i, _, n in slow_blocks(pred, ref) for k in range(n) if a0 <= i + k < a1}
        kept = {i + k for i, _, n in slow_blocks(pred, fixed) for k in range(n)}
        assert row["d"]["correct_tokens"] == len(right) and row["d"]["false_corr"] == len(right - kept)
    short = spark.createDataFrame([("a b", "a b")], "p string, r string").select(M.span_score(F.col("p"), F.col("r"))["cer"].alias("c")).first()["c"]
    assert short is None


def test_streams_end_and_carry_state(spark, tmp_path):
    from quire.streaming import limits

    rows = [(1, i, f"2024-01-01 00:00:{s:02d}", s != 3) for i, s in enumerate([0, 1, 2, 30, 40])]
    for n, part in enumerate((rows[:2], rows[2:])):  # two files, two batches
        spark.createDataFrame(part, "k long, i long, t string, ok boolean").select("k", "i", F.col("t").cast("timestamp").alias("ts"), "ok").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("k long, i long, ts timestamp, ok boolean").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withWatermark("ts", "10 minutes")
    out = limits.limited_stream(source, "k", "i", 2, 60)
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert sum(r["allowed"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == 2
    batch = spark.read.parquet(str(tmp_path / "in"))
    assert {r["i"]: r["allowed"] for r in limits.allowed_hits(batch.union(batch.where("i < 0")), "k", "i", 2, 60).collect()} == {0: True, 1: True, 2: False, 3: False, 4: False}
    nulls = spark.createDataFrame([(None, 1, None, False), (None, 2, "2024-01-01 00:00:00", False), (5, 3, "2024-01-01 00:00:00", False)], "k long, i long, t string, ok boolean").withColumn("ts", F.col("t").cast("timestamp"))
    assert {r["i"]: r["made"] for r in limits.made_calls(nulls, "k", "i", "ok", 1, 60).collect()} == {1: False, 2: True, 3: True}


def test_index_serves_its_pages_alone(spark, tmp_path):
    from quire.operators import search as S
    from quire.operators.index import open_index

    pages = spark.createDataFrame([(i, "b" if i % 2 else "c", i, t) for i, t in enumerate(["the quick brown fox jumps", "quick brown dogs", None, "", "lazy foxes sleep"])], "id long, book string, page long, raw string")
    pages.write.parquet(str(tmp_path / "p"))
    index = open_index(spark.read.parquet(str(tmp_path / "p")), str(tmp_path / "index"))
    assert index.n == 5 and [r["id"] for r in S.search_trigram(index, "quick brown", 5).collect()] == [1, 0]
    assert [r["id"] for r in S.search_trigram(index, "quick brown", 5, book="b").collect()] == [1]
    assert S.search_trigram(index, "", 5).count() == 0 and S.search_trigram(index, "zzzz", 5).count() == 0
    got = S.search(index, "quick brown", 2, "semantic").collect()
    assert [r["mode"] for r in got] == [S.UNAVAILABLE] * 2 and got[1]["snippet"] == "the quick brown fox jumps"
    assert one(spark, S.snippet(F.col("t"), ["a"]), t=" \n ") == " \n " and one(spark, S.snippet(F.col("t"), []), t="abc") == "abc"
    words = " ".join(["x"] * 50 + ["q"] + ["y"] * 50)
    assert one(spark, S.snippet(F.col("t"), ["q"]), t=words).startswith("x x") and " q" in one(spark, S.snippet(F.col("t"), ["q"]), t=words)


def test_snippets_of_pages_without_words_are_no_rows_as_in_sql(spark, tmp_path):
    import duckdb

    from quire.plans import ORACLES, QUERIES

    texts = [None, "", "   ", "\n\t\r\f ", "x", "the thing", " ".join(["x"] * 50 + ["the"] + ["y"] * 50), " the " * 80]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = sorted(con.execute(ORACLES["snippet_window"]).fetchall())
    assert [i for i, _ in want] == [4, 5, 6, 7] and sorted(map(tuple, QUERIES["snippet_window"](spark, str(tmp_path)).collect())) == want


def test_entry_survives_without_training_operators():
    import subprocess
    import sys

    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; assert len(e.queries()) > 100 and 'pipeline' not in e.queries() and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=str(__import__("pathlib").Path(__file__).parent.parent))


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", ["book_stats", "facet_decade", "prev_next", "tally", "dedupe_first", "export_tei", "sitemap_chunks", "even_subsample", "align_scores", "align_selftest", "silver_gold", "layout_votes", "html_record", "oai_page2", "merge_names", "place_index", "rate_limit_streamed", "search_page_hybrid", "quartile_summary", "reading_order"])
def test_queries_equal_sql(spark, name):
    import duckdb

    import __spark_entry__ as e

    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "orders", "labels", "benchmark", "events", "part", "embeddings", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    found = e.queries()[name](spark, sf)
    columns = sorted(found.columns)
    want = con.execute(e.oracle_sql()[name])
    at = [[d[0] for d in want.description].index(c) for c in columns]
    plain = lambda rows: sorted((tuple(round(float(x), 5) if isinstance(x, float) else x for x in r) for r in rows), key=repr)
    assert plain(tuple(r[c] for c in columns) for r in found.collect()) == plain(tuple(r[i] for i in at) for r in want.fetchall())
