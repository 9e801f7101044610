"""op13: the chosen-path join against all pairs, by an inverted index."""

import collections
import random

import numpy as np
import pytest

from quire.llm import chosen_path, confirm, registry


def shingle_sets(rows):
    out = []
    for key, text in rows:
        words = (text or "").encode().lower().split()  # bytes.lower and split know ASCII only
        out.append((key, frozenset([tuple(words)] if 0 < len(words) < 5 else zip(*(words[i:] for i in range(5)), strict=False))))
    return out


def by_hand(rows, percent=85):
    """(key, n, component) with every pair of sets that share a shingle compared."""
    sets = shingle_sets(rows)
    first = {}
    for i, (_, s) in enumerate(sets):
        first.setdefault(s, i)
    index, up = collections.defaultdict(list), list(range(len(sets)))

    def top(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, (_, s) in enumerate(sets):
        if s and first[s] != i:
            up[top(i)] = top(first[s])
    for s, i in first.items():
        shared = collections.Counter(j for x in s for j in index[x])
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j][1]) - n):
                up[top(i)] = top(j)
        for x in s:
            index[x].append(i)
    least = {}
    for i, (key, _) in enumerate(sets):
        if key is not None:
            least[top(i)] = min(key, least.get(top(i), key))
    return sorted(((k, len(s), least.get(top(i))) for i, (k, s) in enumerate(sets)), key=str)


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "id long, body string").selectExpr("id", "body", "1 AS key", "'x' AS fp", "2L AS n", "3 AS node").repartition(3)
    return sorted((tuple(r) for r in chosen_path.classes(df, "id", "body", **options).collect()), key=str)


def test_groups_of_all_kinds(spark):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(5000)]
    text = lambda n: [rnd.choice(words) for _ in range(n)]
    passage, rows = text(120), []
    for _ in range(40):  # near copies around the threshold, short and long
        base = text(rnd.choice([30, 80, 300, 3000]))
        for _ in range(rnd.randint(1, 4)):
            copy = list(base)
            for _ in range(max(1, int(len(copy) * rnd.choice([0.005, 0.012, 0.016, 0.018, 0.02, 0.03])))):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            rows.append(" ".join(copy))
        rows.append(" ".join(base))
    hot = text(200)
    for _ in range(250):  # one large group of near copies, and texts with a passage in common
        copy = list(hot)
        copy[rnd.randrange(200)] = rnd.choice(words)
        rows += [" ".join(copy), " ".join(passage + text(rnd.choice([15, 60, 200])))]
    rows += ["", None, " \n", "one", "ONE", "two words", "x " * 4, "x " * 5, "x " * 900] + rows[:3] * 2
    rnd.shuffle(rows)
    rows = [(i if i % 50 else None, t) for i, t in enumerate(rows)]
    want = by_hand(rows)
    assert len({c for _, _, c in want}) < len(want)
    assert run(spark, rows) == want
    assert run(spark, rows, small=2) == want  # nodes that are large at once: deeper trees
    assert run(spark, rows, small=3, deepest=2) == want  # what is left at the deepest level is compared in blocks


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = registry.QUERIES["op13_chosen_path_join"](spark, sf).collect()
    assert sorted((tuple(r)[:3] for r in got), key=str) == by_hand(rows) and all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_empty_table(spark):
    assert run(spark, [(1, "a b c d e f")])[0] == (1, 2, 1)
    assert chosen_path.classes(spark.createDataFrame([], "id long, body string"), "id", "body").count() == 0


@pytest.mark.parametrize(("n", "good"), [(850, True), (849, False)])
def test_border(n, good):
    import numpy as np

    assert confirm.linked(np.arange(n), np.arange(1000), chosen_path.PERCENT) is good


def test_parities_rule_out_near_misses_and_no_link():
    r = np.random.default_rng(3)
    for n in (1, 7, 60, 400, 3000):
        for changed in (0, 1, n // 20, n // 13, n // 12, n // 11, n // 5):
            a = np.unique(r.integers(0, 2**64, n, dtype=np.uint64))
            b = np.unique(np.concatenate([a[changed:], r.integers(0, 2**64, changed, dtype=np.uint64)]))
            p, q = (chosen_path.signature(x)[1].view("<u8")[None] for x in (a, b))
            both = len(np.intersect1d(a, b))
            linked = 100 * both >= 85 * (len(a) + len(b) - both)
            out = bool(chosen_path.beyond(p, q, np.array([len(a) + len(b)]), 85)[0])
            assert not (linked and out)
            if n in (60, 400) and changed == n // 5:
                assert out


def test_a_group_of_near_misses_makes_few_pairs(spark, monkeypatch):
    """60 texts that overlap by 0.8: none of their 1,770 pairs needs the whole sets, but the group's linked pair is found."""
    core = " ".join(f"c{i}" for i in range(400))
    rows = [(k, core + " " + " ".join(f"t{k}x{i}" for i in range(45))) for k in range(60)] + [(60, core + " " + " ".join(f"t59x{i}" for i in range(40)))]
    asked = []
    links_of = confirm.Confirmed.links_of
    monkeypatch.setattr(confirm.Confirmed, "links_of", lambda self, pairs: asked.append(pairs.count()) or links_of(self, pairs))
    got = {r["key"]: r["component"] for r in chosen_path.classes(spark.createDataFrame(rows, "id long, body string"), "id", "body").collect()}
    assert got == {k: k for k in range(60)} | {60: 59} and sum(asked) <= 20
