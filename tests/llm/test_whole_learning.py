"""What operators learn comes from all rows, and is the same however these are dealt."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import secrets, toxicity
from quire.llm._common import fit_logistic, logistic_steps, logistic_sums, materialise, nth_smallest


def test_ranks_and_curves_over_a_table(spark):
    r = np.random.default_rng(4)
    values = np.r_[r.normal(0, 1, 500), np.exp(r.normal(0, 9, 500)), np.full(300, 0.25)]
    table = materialise(spark.createDataFrame([(float(v), int(r.random() < 1 / (1 + np.exp(-min(v, 30.0))))) for v in values], "v double, y int").repartition(7), "v")
    for n in (0, 1, 499, 650, 651, 1298, 1299):
        assert nth_smallest(table, "v", n) == np.sort(values)[n]
    rows = table.where("abs(v) < 3").collect()
    x, y = (np.array([row[c] for row in rows], float) for c in ("v", "y"))
    assert fit_logistic(table.where("abs(v) < 3"), "v", "y") == pytest.approx(logistic_steps(lambda w: logistic_sums(x, y, w)), abs=1e-6)


def test_secret_network_learns_from_every_text(spark):
    """20,600 texts whose findings are few but in all of them: each is a labelled finding, over several shares."""
    docs = spark.range(20_600).select(F.concat(F.lit("see token = "), F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 30), F.lit(" or reportsectionchapterhouse ")).alias("text"))
    s = secrets.Settings(examples=600, rounds=1, share=12_000)
    found = materialise(secrets.labelled_findings(docs, "text", s), "f")
    assert {r["label"]: r["count"] for r in found.groupBy("label").count().collect()}[0] == 20_600
    assert found.select("h").distinct().count() == 20_600
    nets = [secrets.fit(found.repartition(n), s) for n in (2, 5)]
    assert np.array_equal(nets[0].vector(), nets[1].vector()) and nets[0].threshold == nets[1].threshold
    scan = secrets.scan("see token = 0123456789abcdef0123456789abcd or reportsectionchapterhouse ", nets[0], s)[1]
    assert [k for *_, k in scan if k < 3] == [0, 2] and all(k < 3 for *_, k in scan)


def test_toxicity_learns_from_every_labelled_text(spark):
    """24,000 labelled texts of the training fold: the model counts each, and a word that only the last thousand of a sample's order hold is learned."""
    ids = spark.range(45_000).select(F.col("id").alias("doc_id"))
    fold = ids.where(toxicity.residue("doc_id", 4) != 2)
    order = [r[0] for r in fold.orderBy(F.xxhash64("doc_id"), "doc_id").select("doc_id").collect()]
    late = spark.createDataFrame([(i,) for i in order[24_000:]], "late long")
    rows = materialise(ids.join(late, F.col("doc_id") == F.col("late"), "left").select("doc_id", F.when(F.col("late").isNotNull(), "a quaglot on the river").otherwise("a stone by the river").alias("text"), F.col("late").isNotNull().cast("int").alias("toxic")), "docs")
    labels = rows.where("doc_id % 7 <> 3").select("doc_id", "toxic").union(rows.where("doc_id = 4").select("doc_id", F.lit(None).cast("int")))
    known = toxicity.labelled_texts(rows.select("doc_id", "text"), labels)
    wanted = fold.where("doc_id % 7 <> 3").count()
    assert wanted > 24_000 and known.count() == wanted == known.select("doc_id").distinct().count()
    model = toxicity.fit(known, "doc_id", "text", "toxic")
    assert model.texts == wanted and model.weights["=quaglot"] > 0.5
    assert model.score(model.evidence("a quaglot")) >= 0.3 > model.score(model.evidence("a stone"))


def test_highest_rows_are_all_there(spark):
    rows = materialise(spark.range(5000).select((F.col("id") * 37 % 1000).alias("n")).repartition(5), "n")
    assert sorted(r[0] for r in toxicity._highest(rows, "n", 12).collect()) == [997] * 5 + [998] * 5 + [999] * 5
    assert toxicity._highest(rows, "n", 5000).count() == 5000
