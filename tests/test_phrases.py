"""Phrases on pages: the automaton and the joins against a search through every run of words."""

import random

from quire.operators import phrases


def test_automaton_and_joins_find_the_same(spark):
    rnd = random.Random(1)
    words = list("abcde")
    entries = list({(" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 4))), rnd.randrange(30)) for _ in range(60)}) + [("f", 1), ("", 2), (None, 3)]
    pages = [(i % 3, i, " ".join(rnd.choice(words + ["x", "", "y"]) for _ in range(rnd.randint(0, 30)))) for i in range(200)] + [(0, 900, None), (0, 901, ""), (0, 902, "f")]
    want = set()
    for book, page, txt in pages:
        w = [x for x in (txt or "").split(" ") if x]
        runs = {" ".join(w[i:j]) for i in range(len(w)) for j in range(i + 1, len(w) + 1)}
        want |= {(e, book, page) for p, e in entries if p and p in runs}
    df = spark.createDataFrame(pages, "book int, page long, txt string").selectExpr("txt", "page", "book", "1 AS id").repartition(3)
    dictionary = spark.createDataFrame(entries, "phrase string, id int")
    for most in (1000, 5):
        got = [tuple(r) for r in phrases.found(df, dictionary, most).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_falls_back_to_shorter_phrases():
    a = phrases.Automaton([("a b c d", 1), ("b c", 2), ("c", 3), ("b c x", 4)])
    assert a.entries("a b c x".split()) == {2, 3, 4} and a.entries("a b c d".split()) == {1, 2, 3} and a.entries(["z"]) == set()
    assert phrases.Automaton([]).entries(["a"]) == set()
