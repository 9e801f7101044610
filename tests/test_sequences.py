"""Edit distance and matching blocks against the table of all prefixes and the standard library's matcher."""

import difflib
import random
import time

from quire.functions.sequences import distance, matching_blocks


def test_distance_and_blocks():
    rnd = random.Random(4)
    for _ in range(400):
        a, b = ([rnd.choice("abcd"[: rnd.randint(1, 4)]) for _ in range(rnd.randrange(14))] for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            diagonal, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
        assert distance(a, b) == distance(b, a) == row[-1]
        assert matching_blocks(a, b) == [tuple(m) for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()[:-1]]


def test_pages_of_5000_tokens():
    rnd = random.Random(5)
    a = [f"w{min(int(rnd.paretovariate(0.7)), 3000)}" for _ in range(5000)]
    b = [w if rnd.random() < 0.8 else "x" for w in a]
    began = time.time()
    assert 800 < distance(a, b) < 1200 and sum(n for *_, n in matching_blocks(a, b)) > 3500
    assert time.time() - began < 20
