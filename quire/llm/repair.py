"""Repair of conversations' structure as a shortest path through composed finite-state machines.

Three machines are composed: an acceptor of a conversation's rows, a transducer of edits (keep, rerole, delete, insert, each with
a cost) and an acceptor of the role grammar ``(s?(ua)+)?``. A state of the composition is (rows read, grammar state), and its
arcs are made when they are first asked for, by a row's kind. Weights are (cost, labels), compared in that order. From
each state a label leads to one state only, so going backwards through the rows, which is the topological order reversed, the best
labels begin with the least label among the cheapest arcs: no strings are compared or kept.

A conversation may hold any share of all rows. Rows are sorted over key ranges, so one conversation may lie in many tasks, and are
cut into segments. A segment's costs between grammar states are a 4 x 4 matrix; a pass over the matrices gives the cost of all that
follows each segment, with which the segment's own best edits are known for each state it may be entered in; a second pass over
those exits says in which it is. Only the two finished columns of a conversation, its labels and its digest, meet in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import chain, pairwise

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm._common import materialise, slices

KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
WHITE = " \t\n\x0b\x0c\r"
#: The role grammar's acceptor: nothing yet, a system row, a user row, an assistant row last.
GRAMMAR: tuple[dict[str, int], ...] = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FINAL = (0, 3)
NAMES = {"u": "user", "a": "assistant"}
STATES, FAR = range(4), 1 << 50
#: Fault of a row: none, blank, duplicate, truncated.
SOUND, BLANK, TWICE, SHORT = range(4)
#: Rows and bytes of text that a segment holds at most (a longer text is a segment of its own).
ROWS, BYTES = 2000, 4_000_000

Arc = tuple[str, int, str | None, int]  # label, cost, the role that is written (None: the row's own), next grammar state


@cache
def arcs(initial: str, fault: int) -> tuple[tuple[Arc, ...], ...]:
    """For each grammar state the composed arcs that read a row, least label first."""
    cut = CUT if fault == SHORT else 0
    out = []
    for state in STATES:
        found: list[Arc] = [("D", DELETE, None, state)]
        if fault not in (BLANK, TWICE):
            if initial in GRAMMAR[state]:
                found.append(("K", KEEP + cut, None, GRAMMAR[state][initial]))
            found += [("R", REROLE + cut, name, GRAMMAR[state][letter]) for letter, name in NAMES.items() if letter in GRAMMAR[state]]
        out.append(tuple(found))
    return tuple(out)


#: The arcs that read nothing.
INSERTS: tuple[tuple[Arc, ...], ...] = tuple(tuple(("I", INSERT, name, GRAMMAR[s][letter]) for letter, name in NAMES.items() if letter in GRAMMAR[s]) for s in STATES)


def relaxed(costs: list[int], choices: list[Arc | None]) -> None:
    """Let a node's states reach each other by insertions, in place. Two in a row are the most that can pay."""
    for _ in range(2):
        for state in STATES:
            for arc in INSERTS[state]:
                c = arc[1] + costs[arc[3]]
                if c < costs[state] or c == costs[state] and c < FAR and arc[0] < (choices[state] or arc)[0]:
                    costs[state], choices[state] = c, arc


def ends() -> tuple[list[int], list[Arc | None]]:
    """The node after a conversation's last row."""
    costs: list[int] = [0 if s in FINAL else FAR for s in STATES]
    choices: list[Arc | None] = [None] * 4
    relaxed(costs, choices)
    return costs, choices


def backward(kinds: list[tuple[str, int, int]], after: list[int]) -> tuple[list[int], list[list[Arc]]]:
    """kinds: (initial, fault, copies) of a segment's rows; after: the costs from its end on. The costs from its beginning on and each node's best arcs, last node first.

    Further copies of a row are duplicates, whose deletion leaves the state as it is: they cost the same for every state.
    """
    costs, nodes = list(after), []
    for initial, fault, copies in reversed(kinds):
        more = DELETE * (copies - 1) if copies > 1 else 0
        new, best = [], []
        for options in arcs(initial, fault):
            least = None
            for arc in options:
                c = arc[1] + costs[arc[3]] + more
                if least is None or c < least:
                    least, chosen = c, arc
            new.append(min(least, FAR))
            best.append(chosen)
        relaxed(new, best)
        costs = new
        nodes.append(best)
    return costs, nodes


def matrix(kinds: list[tuple[str, int, int]]) -> list[int]:
    """Costs from each state at a segment's beginning to each at its end, row by row."""
    columns = [backward(kinds, [0 if s == t else FAR for s in STATES])[0] for t in STATES]
    return [columns[t][s] for s in STATES for t in STATES]


def walk(kinds: list[tuple[str, int, int]], after: list[int], state: int, last: bool) -> Iterator[tuple[int, Arc]]:
    """The best edits from a state on: (row, arc), with the state they lead to in the arc. A deleted run of copies is one step."""
    _, nodes = backward(kinds, after)
    for i, best in enumerate(reversed(nodes)):
        while (arc := best[state])[0] == "I":
            yield i, arc
            state = arc[3]
        yield i, arc
        state = arc[3]
    if last:
        choices = ends()[1]
        while (arc := choices[state]) is not None:
            yield len(kinds), arc
            state = arc[3]


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n: rows after damage by crc32 of ``conv_id:turn``, equal ones as one with their number. Nulls count as one space."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.pmod(F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")), F.lit(20))
    text = F.when(code == 1, "").when(code == 2, F.translate(part("text"), ".!?", "")).otherwise(part("text"))
    role = F.when(code == 4, "user").otherwise(part("role"))
    return rows.where(code != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(code == 3, 2).otherwise(1).alias("n")).groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))


def judged(rows: DataFrame) -> DataFrame:
    """damaged() rows with the fault of a row's first copy; its further copies are duplicates, or all blank."""
    place = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    first = rows.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.md5("text").alias("m")).agg(F.min(place).alias("first"))
    met = rows.join(first, rows.conv_id.eqNullSafe(first.c) & (rows.role == first.r) & (F.md5("text") == first.m))
    bare = F.rtrim(F.col("text"), F.lit(WHITE))
    fault = F.when(bare == "", BLANK).when(~place.eqNullSafe(F.col("first")), TWICE).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), SHORT).otherwise(SOUND)
    return met.select("conv_id", "turn", "role", "text", "n", fault.alias("fault"))


_SEGMENT = "conv_id {0}, seg long, roles array<string>, texts array<string>, copies array<long>, faults array<int>, costs array<long>, illegal long, head string, tail string"


def _segments(rows: DataFrame) -> DataFrame:
    """A written table of segments of the sorted rows, in the order of seg within a conversation."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = _SEGMENT.format(rows.schema["conv_id"].dataType.simpleString())
    arrow = to_arrow_schema(rows.sparkSession.createDataFrame([], schema).schema)
    legal = {"su", "ua", "au"}

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, conv, held, size = TaskContext.get().partitionId() << 32, None, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal number
            kinds = [(role[:1], fault, n) for role, _, n, fault in held]
            inner = sum(n - 1 for _, _, n in kinds) + sum(p[0] + q[0] not in legal for p, q in pairwise(kinds))
            roles, texts, copies, faults = map(list, zip(*held, strict=True))
            number += 1
            return pa.RecordBatch.from_pylist([{"conv_id": conv, "seg": number, "roles": roles, "texts": texts, "copies": copies, "faults": faults, "costs": matrix(kinds), "illegal": inner, "head": kinds[0][0], "tail": kinds[-1][0]}], arrow)

        for batch in slices(batches):
            for c, *row in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5)), strict=True):
                if held and (c != conv or len(held) >= ROWS or size + len(row[1]) > BYTES):
                    yield flush()
                    held, size = [], 0
                conv = c
                held.append(row)
                size += len(row[1])
        if held:
            yield flush()

    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    return materialise(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(compute, schema), "segments")


def _streamed(df: DataFrame, back: bool, f, schema: str) -> DataFrame:
    """f over each conversation's segments in turn (back: last first), fed one by one from a sorted partition: it keeps no rows."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in f(row for b in batches for row in b.to_pylist()):
            yield pa.RecordBatch.from_pylist(batch[0], batch[1])

    order = F.col("seg").desc() if back else F.col("seg")
    return df.repartition("conv_id").sortWithinPartitions("conv_id", order).mapInArrow(compute, schema)


_AFTER = pa.schema([("seg", pa.int64()), ("after", pa.list_(pa.int64())), ("last", pa.bool_()), ("alone", pa.bool_())])
_ENTRY = pa.schema([("seg", pa.int64()), ("entry", pa.int32())])


def _follow(rows: Iterator[dict]) -> Iterator[tuple[list[dict], pa.Schema]]:
    """From segments last first: the cost of all that follows each, for each state at its end."""
    out, held, begun = [], None, False
    for row in chain(rows, [None]):
        if held is not None:
            starts = row is None or row["conv_id"] != held["conv_id"]
            if not begun:
                after = ends()[0]
            out.append({"seg": held["seg"], "after": after, "last": not begun, "alone": starts and not begun})
            m = held["costs"]
            after, begun = [min(FAR, *(m[4 * s + t] + after[t] for t in STATES)) for s in STATES], not starts
        held = row
        if len(out) > 1000 or row is None and out:
            yield out, _AFTER
            out = []


def _enter(rows: Iterator[dict]) -> Iterator[tuple[list[dict], pa.Schema]]:
    """From segments in order with the states that each leads to: the state in which each is entered."""
    out, conv, state = [], object(), 0
    for row in rows:
        if row["conv_id"] != conv:
            conv, state = row["conv_id"], 0
        out.append({"seg": row["seg"], "entry": state})
        state = row["exits"][state]
        if len(out) > 1000:
            yield out, _ENTRY
            out = []
    if out:
        yield out, _ENTRY


def _kinds(row: dict) -> list[tuple[str, int, int]]:
    return [(role[:1], fault, n) for role, fault, n in zip(row["roles"], row["faults"], row["copies"], strict=True)]


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            kinds, exits = _kinds(row), []
            for state in STATES:
                *_, (_, arc) = walk(kinds, row["after"], state, False)
                exits.append(arc[3])
            yield pa.RecordBatch.from_arrays([pa.array([row["conv_id"]], batch.schema[0].type), pa.array([row["seg"]], pa.int64()), pa.array([exits], pa.list_(pa.int32()))], ["conv_id", "seg", "exits"])


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each segment's labels, cost and repaired rows."""
    for batch in batches:
        for row in batch.to_pylist():
            labels, lines, cost = [], [], 0
            for i, (label, price, role, _) in walk(_kinds(row), row["after"], row["entry"], row["last"]):
                labels.append(label)
                cost += price
                if label == "I":
                    lines.append(f"{role}:")
                    continue
                if label != "D":
                    lines.append(f"{role or row['roles'][i]}:{row['texts'][i]}")
                labels.append("D" * (row["copies"][i] - 1))
                cost += DELETE * (row["copies"][i] - 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["conv_id"]], batch.schema[0].type), *(pa.array([x], kind) for x, kind in ((row["seg"], pa.int64()), ("".join(labels), pa.string()), ("\n".join(lines), pa.string()), (cost, pa.int64()), (row["illegal"], pa.int64()), (row["head"], pa.string()), (row["tail"], pa.string())))],
                ["conv_id", "seg", "audit", "repaired", "cost", "illegal", "head", "tail"],
            )


def _joined(kind: pa.DataType):
    """Conversations from their segments' results in order; a conversation's text passes through its digest and isn't kept."""
    schema = pa.schema([("conv_id", kind), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def join(rows: Iterator[dict]) -> Iterator[tuple[list[dict], pa.Schema]]:
        held = None
        for row in chain(rows, [None]):
            if held is not None and (row is None or row["conv_id"] != held["conv_id"]):
                yield [held | {"audit": "".join(held["audit"]), "repaired_sha256": digest.hexdigest()}], schema
                held = None
            if row is None:
                return
            if held is None:
                held, digest, empty = {"conv_id": row["conv_id"], "illegal": 0, "cost": 0, "audit": []}, hashlib.sha256(), True
            else:
                held["illegal"] += tail + row["head"] not in ("su", "ua", "au")
            tail = row["tail"]
            held["illegal"] += row["illegal"]
            held["cost"] += row["cost"]
            held["audit"].append(row["audit"])
            if row["repaired"]:
                digest.update((("" if empty else "\n") + row["repaired"]).encode())
                empty = False

    return join


def repair(rows: DataFrame) -> DataFrame:
    """rows(conv_id, turn, role, text) after damage, with n equal copies each: (conv_id, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256, gaps).

    Rows of one turn come in the order of role and text (by bytes), null turns first; all rows with a null conv_id are one
    conversation. An empty role has no initial and so no place in the grammar: it is reroled or deleted. A role other than user and
    assistant that begins with u or a is kept as it is. An empty table gives an empty one.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = rows.schema["conv_id"].dataType
    name, arrow = kind.simpleString(), to_arrow_type(kind)
    rows = materialise(judged(rows), "judged")
    count = lambda fault: F.sum(F.when(F.col("fault") == fault, F.col("n")).otherwise(0))
    by_turn = rows.groupBy("conv_id", "turn").agg(
        count(BLANK).alias("blank"),
        F.sum(F.when(F.col("fault") == TWICE, F.col("n")).when(F.col("fault") != BLANK, F.col("n") - 1).otherwise(0)).alias("duplicate"),
        count(SHORT).alias("short"),
        F.sum(F.when(F.col("fault") == SHORT, 1).otherwise(0)).alias("truncated"),
    )
    counts = by_turn.groupBy("conv_id").agg(*[F.sum(c).cast("long").alias(c) for c in ("blank", "duplicate", "truncated")], F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"))
    segments = _segments(rows)
    after = materialise(_streamed(segments.select("conv_id", "seg", "costs"), True, _follow, "seg long, after array<long>, last boolean, alone boolean"), "after")
    many = segments.join(after.where("NOT alone"), "seg").select("conv_id", "seg", "roles", "copies", "faults", "after")
    exits = materialise(many.mapInArrow(_exits, f"conv_id {name}, seg long, exits array<int>"), "exits")
    entries = _streamed(exits, False, _enter, "seg long, entry int")
    known = after.join(entries, "seg", "left").select("seg", "after", "last", F.coalesce("entry", F.lit(0)).alias("entry"))
    full = segments.join(known, "seg").select("conv_id", "seg", "roles", "texts", "copies", "faults", "after", "last", "entry", "illegal", "head", "tail")
    pieces = full.mapInArrow(_written, f"conv_id {name}, seg long, audit string, repaired string, cost long, illegal long, head string, tail string")
    whole = _streamed(pieces, False, _joined(arrow), f"conv_id {name}, illegal long, cost long, audit string, repaired_sha256 string")
    counts = counts.withColumnRenamed("conv_id", "c")
    return whole.join(counts, whole.conv_id.eqNullSafe(counts.c)).drop("c")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's faults after damage and its cheapest repair; one without rows after damage has zeros and empty texts. See repair() for nulls and ties."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    every = rows.select("conv_id").distinct()
    done = repair(damaged(rows)).withColumnRenamed("conv_id", "c")
    longs = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    out = every.join(done, every.conv_id.eqNullSafe(done.c), "left")
    return out.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in longs], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def _sql() -> str:
    def best(*options: str) -> str:
        return f"list_min([{', '.join(options)}])"

    def step(v: str, label: str, cost: str, line: str | None, when: str = "true") -> str:
        lines = f"list_concat([{line}], v.{v}.r)" if line else f"v.{v}.r"
        return f"{{'c': CASE WHEN {when} THEN v.{v}.c + {cost} ELSE 1000000000 END, 's': '{label}' || v.{v}.s, 'r': {lines}}}"

    free, cut = "d.fault NOT IN (1, 2)", "5 * (d.fault = 3)::INT"

    def read(v: str, keep: str, to: str, role: str) -> str:
        return best(step(v, "D", "2", None), *[step(t, "K", cut, "d.role || ':' || d.text", f"{free} AND left(d.role, 1) = '{letter}'") for letter, t in (k.split(">") for k in keep.split())], step(to, "R", f"1 + {cut}", f"'{role}:' || d.text", free))

    def insert(v: str, role: str) -> str:
        return f"{{'c': {v}.c + 5, 's': 'I' || {v}.s, 'r': list_concat(['{role}:'], {v}.r)}}"

    end = "{'c': %d::BIGINT, 's': '%s', 'r': %s::VARCHAR[]}"
    return f"""WITH RECURSIVE tab AS (SELECT list(t ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS t FROM range(256) r(i))),
b AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))), '..'), lambda x: ('0x' || x)::BIGINT)) AS bytes FROM conversations),
c AS (SELECT conv_id, turn, role, text, xor(list_reduce(bytes, lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1])), 4294967295) % 20 AS code FROM b, tab),
w AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE WHEN code = 1 THEN '' WHEN code = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN code = 3 THEN 2 ELSE 1 END)) AS copy FROM c WHERE code <> 0),
o AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM w),
d AS (SELECT conv_id, turn, role, text, i, CASE WHEN bare = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM o),
n AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM d GROUP BY conv_id),
v AS (SELECT conv_id, n + 1 AS i, {end % (0, "", "[]")} AS o, {end % (10, "II", "['user:', 'assistant:']")} AS s, {end % (5, "I", "['assistant:']")} AS u, {end % (0, "", "[]")} AS a FROM n
UNION ALL SELECT conv_id, i, {best("o", insert("u", "user"))}, {best("s", insert("u", "user"))}, u, a FROM (SELECT conv_id, i, o, s, {best("u", insert("a", "assistant"))} AS u, {best("a", insert("u", "user"))} AS a
FROM (SELECT v.conv_id, d.i, {read("o", "s>s u>u", "u", "user")} AS o, {read("s", "u>u", "u", "user")} AS s, {read("u", "a>a", "a", "assistant")} AS u, {read("a", "u>u", "u", "user")} AS a FROM v JOIN d ON d.conv_id IS NOT DISTINCT FROM v.conv_id AND d.i = v.i - 1)))
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(v.o.c, 0)::BIGINT AS cost, coalesce(v.o.s, '') AS audit, sha256(coalesce(array_to_string(v.o.r, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) e LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN v ON v.conv_id IS NOT DISTINCT FROM e.conv_id AND v.i = 1"""


#: The same in DuckDB: the shortest path row by row from each conversation's end.
OP12_SQL = _sql()
