"""op11: token alignment against a version that compares all byte ranges of a text."""

import collections
import hashlib

import pytest

from quire.llm import alignment, registry
from quire.llm.encoding import BYTE_BPE, tokenizer_path

SF = "/root/testdata/sf0.001"
PATHS = (tokenizer_path(BYTE_BPE), tokenizer_path(alignment.PIECE_BPE))


@pytest.fixture(scope="module")
def slow():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=PATHS[1])
    visible = [x for x in range(256) if 33 <= x <= 126 or 161 <= x <= 172 or 174 <= x <= 255]
    letters = {chr(x): x for x in visible} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in visible)}

    def spans(tokens):
        end, out = 0, []
        for i, data in tokens:
            out.append((i, end, end + len(data)))
            end += len(data)
        return out

    def one(text):
        """(A ids with ranges, B ids with ranges), links, groups."""
        if not text:
            return [], [], [], ""
        ta = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        tb = [(i, bytes([int(p[3:5], 16)]) if len(p := b.id_to_piece(i)) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()) for i in b.encode(text)]
        if any(b"".join(d for _, d in t) != (" " + text).encode() for t in (ta, tb)):
            return [], [], [], ""
        sa, sb = spans(ta), spans(tb)
        links = [(x[0], y[0]) for x in sa for y in sb if x[1] < y[2] and y[1] < x[2]]
        cuts = sorted({x[2] for x in sa} & {y[2] for y in sb})
        groups, before = [], 0
        for c in cuts:
            groups.append("|".join(",".join(str(i) for i, s, e in side if before <= s and e <= c) for side in (sa, sb)))
            before = c
        return sa, sb, links, ";".join(groups)

    def run(rows):
        every = [(k, one(t)) for k, t in rows]
        counts = collections.Counter(p for _, o in every for p in set(o[2]))
        most = collections.defaultdict(int)
        for (x, _), n in counts.items():
            most[x] = max(most[x], n)
        return sorted((k, len(sa), len(sb), g.count(";") + bool(g), len(ls), sum(counts[p] == most[p[0]] for p in ls), sum(counts[p] for p in ls), g) for k, (sa, sb, ls, g) in every)

    return run


ODD = ["", None, " ", "   ", "a  b\n\nc é😀  x", "▁ x", "  lead", "trail  ", "\n\n a \n b", "tab\tx  y", "a\x85b", "<|endoftext|> hi", "<s> x</s>", "it's  'tis 's", "!", "! ! 0 !!", "①²³ x  ½", "\r\n x \r y", "word", "word"]


def test_odd_texts(spark, slow):
    rows = [(i if i else None, t) for i, t in enumerate(ODD)]
    df = spark.createDataFrame([(k, t, 0, "x") for k, t in rows], "id long, body string, key int, row string").repartition(3)
    for most in (10**6, 0):  # both ways to meet the counts
        got = sorted((tuple(r) for r in alignment.align(df, "id", "body", *PATHS, broadcast_pairs=most).collect()), key=str)
        assert got == sorted(slow([(k, t) for k, t in rows if k is not None]) + slow([(0, "")])[0:0] + [(None, 0, 0, 0, 0, 0, 0, "")], key=str)


def test_query(spark, slow):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if len(r["text"] or "") < 6000}
    every = registry.QUERIES["op11_token_alignment"](spark, SF).collect()
    assert len(every) == spark.read.parquet(f"{SF}/documents.parquet").count()
    want = {r[0]: r for r in slow(list(texts.items()))}
    for r in every:
        if r["doc_id"] in texts:
            w = want[r["doc_id"]]
            assert tuple(r)[1:5] == w[1:5] and r["groups_sha256"] == (hashlib.sha256(w[7].encode()).hexdigest() if w[7] else "")
    if len(texts) == len(every):
        assert sorted(tuple(r)[:7] for r in every) == [w[:7] for w in sorted(want.values())]


def test_long_text_and_empty_table(spark, slow):
    long = "wörd tokenization 12345 !? " * 80_000  # 2 MB; the array functions hold some 100 bytes of memory for each
    df = spark.createDataFrame([(1, long), (2, "wörd")], "doc_id long, text string")
    one, two = sorted(alignment.align(df, "doc_id", "text", *PATHS).collect())
    assert one["n_links"] == one["n_a"] + one["n_b"] - one["n_groups"] and two["count_sum"] == slow([(1, long[:4]), (2, "wörd")])[1][6]
    assert alignment.align(df.limit(0), "doc_id", "text", *PATHS).count() == 0
