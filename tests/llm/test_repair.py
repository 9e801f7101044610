"""op12: conversation repair against its SQL and against a search through all edits."""

import functools
import hashlib
import itertools
import random
import re

import pytest

from quire.llm import registry, repair

LEGAL, WHITE = ("su", "ua", "au"), " \t\n\x0b\x0c\r"


def by_hand(rows):
    """(blank, duplicate, truncated, illegal, cost, audit, sha256) of damaged rows in order: every edit is tried at every place."""
    seen, faults = set(), []
    for role, text in rows:
        bare = text.rstrip(WHITE)
        faults.append(1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0)
        seen.add((role, text))

    @functools.cache
    def best(i, done, inserted):
        """Cheapest (cost, labels, lines) of the rows from i on, after the initials so far (the last ones are enough)."""
        found = []
        if i == len(rows):
            if done in ("", "a"):
                found.append((0, "", ()))
        else:
            role, text = rows[i]
            c, l, t = best(i + 1, done, 0)
            found.append((c + 2, "D" + l, t))
            if faults[i] not in (1, 2):
                for label, price, name in (("K", 0, role), ("R", 1, "user"), ("R", 1, "assistant")):
                    if legal(done, name[:1]):
                        c, l, t = best(i + 1, name[0], 0)
                        found.append((c + price + 5 * (faults[i] == 3), label + l, (f"{name}:{text}", *t)))
        if inserted < 4:
            for name in ("user", "assistant"):
                if legal(done, name[0]):
                    c, l, t = best(i, name[0], inserted + 1)
                    found.append((c + 5, "I" + l, (f"{name}:", *t)))
        return min(found, default=(10**9, "", ()))

    def legal(done, letter):
        return letter in {"": "su", "s": "u", "u": "a", "a": "u"}[done] and letter != ""

    cost, audit, lines = best(0, "", 0)
    pairs = [p[0][:1] + q[0][:1] for p, q in itertools.pairwise(rows)]
    return faults.count(1), faults.count(2), faults.count(3), sum(p not in LEGAL for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def order(rows):
    return [(r, t) for turn, r, t, n in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode())) for _ in range(n)]


@pytest.mark.parametrize("rows_a_segment", [1, 3, 2000])
def test_against_all_edits(spark, monkeypatch, rows_a_segment):
    rnd = random.Random(rows_a_segment)
    monkeypatch.setattr(repair, "ROWS", rows_a_segment)
    convs = {}
    for c in [None, *range(150)]:
        convs[c] = list({(rnd.choice([None, *range(6)]), rnd.choice(["system", "user", "assistant", "user", "assistant", "tool", "", "agent", "ser"]), rnd.choice(["a.", "b!", "c", "", " \n", "d?  ", "é。", "a."])): rnd.choice([1, 1, 1, 2, 3]) for _ in range(rnd.randint(1, 8))}.items())
    rows = [(c, turn, r, t, n) for c, held in convs.items() for (turn, r, t), n in held]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n long").repartition(3)
    got = {r["conv_id"]: r for r in repair.repair(df).collect()}
    assert len(got) == len(convs)
    for c, held in convs.items():
        r = got[c]
        assert (r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], r["repaired_sha256"]) == by_hand(order([(*k, n) for k, n in held])), (c, held)
        turns = {k[0] for k, _ in held} - {None}
        assert r["gaps"] == (max(turns) - min(turns) + 1 - len(turns) if turns else 0)


def test_equals_its_sql(spark, tmp_path):
    import duckdb

    odd = [(None, 0, "user", "a."), (None, None, None, None), (7, None, "user", "x"), (7, None, "user", "x"), (7, 1, "assistant", ""), (7, 1, "assistant", "y."), (8, 2, "system", "z. "), (9, 5, "", "q")] + [(100 + i, j, r, t) for i in range(60) for j, (r, t) in enumerate([("user", "a b."), ("assistant", "c d"), ("user", "a b."), ("system", "x!")])]
    spark.createDataFrame(odd, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    for folder, files in ((str(tmp_path), "/*.parquet"), ("/root/testdata/sf0.001", "")):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet{files}'")
        want = con.execute(registry.ORACLES["op12_conversation_repair"])
        names = [d[0] for d in want.description]
        got = registry.QUERIES["op12_conversation_repair"](spark, folder).collect()
        assert sorted(map(str, want.fetchall())) == sorted(str(tuple(r[n] for n in names)) for r in got)


def test_one_long_conversation_and_an_empty_table(spark, monkeypatch):
    monkeypatch.setattr(repair, "ROWS", 7)
    rows = [(1, i // 2, ("user", "assistant", "user")[i % 3], f"t{i % 37}" + "." * (i % 5 > 0), 1) for i in range(3000)]
    schema = "conv_id long, turn long, role string, text string, n long"
    r = repair.repair(spark.createDataFrame(rows, schema)).first()
    import sys

    sys.setrecursionlimit(20_000)
    assert (r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], r["repaired_sha256"]) == by_hand(order([x[1:] for x in rows]))
    assert repair.repair(spark.createDataFrame([], schema)).count() == 0
    long = "word " * 2_000_000
    assert re.fullmatch("D|RI|IR|KI|IK", repair.repair(spark.createDataFrame([(1, 0, "user", long, 1)], schema)).first()["audit"])
