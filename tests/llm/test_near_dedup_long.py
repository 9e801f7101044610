"""Near-dedup of texts beyond a sketch: pairs just under and over 0.8 are told apart on their whole sets."""

import random

import pytest
from pyspark.sql import functions as F

from quire.llm.simhash import near_dedup


@pytest.fixture(scope="module")
def pairs():
    """(share of words in common, two texts) for sets of 700 to 5,000 shingles; the second differs in a tail, so the share is near the Jaccard index."""
    rnd, out = random.Random(3), []
    for n in (700, 1500, 5000):
        for jaccard in (0.77, 0.79, 0.797, 0.803, 0.81, 0.83):
            words = [f"w{rnd.randrange(10**6)}" for _ in range(n)]
            same = int(2 * n * jaccard / (1 + jaccard))
            out.append((" ".join(words), " ".join(words[:same] + [f"v{rnd.randrange(10**6)}" for _ in range(n - same)])))
    return out


def jaccard(a, b):
    p, q = ({tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b))
    return len(p & q) / len(p | q)


def test_long_pairs(spark, pairs):
    rows = [(2 * i + k, t) for i, pair in enumerate(pairs) for k, t in enumerate(pair)]
    kept = {r[0] for r in near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).select("doc_id").collect()}
    assert all(2 * i in kept and (2 * i + 1 in kept) == (jaccard(*pair) < 0.8) for i, pair in enumerate(pairs))


def test_the_tables_long_texts_under_the_threshold_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where(F.col("doc_id").isin(9432, 2467, 9615, 6064))
    assert near_dedup(docs).count() == 4
