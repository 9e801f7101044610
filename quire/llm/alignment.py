"""Alignment of two tokenizers' tokens over the bytes of each text, in Spark's array functions.

Python only tokenises: it gives each text's ids and byte ends under a byte-level vocabulary (A) and a piece vocabulary (B). The
rest is array expressions. Ends are strictly increasing, so the ends of both, each flagged by whose it is, sort into one
array of events, and

* a group ends at each event of both (``array_intersect`` of the ends);
* every event closes one overlap of an A with a B token, so events and links are the same in number and order: an A token's id
  repeats over the events since the A event before it, a B token's likewise, and the two id arrays side by side are the links.

Every step is linear in a text's tokens (sorting merges two sorted runs).
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm._common import documents, materialise, slices
from quire.llm.encoding import BYTE_BPE, Encoder, _byte_letters, tokenizer_path

PIECE_BPE = "piece_bpe_32k.model"
#: Pair counts are broadcast up to so many rows (40 bytes each in a joined relation); beyond it links meet them by a shuffle.
BROADCAST_PAIRS = 1_500_000
_ZERO = -(1 << 30)
_SPACE, _BYTE = "▁", re.compile(r"<0x([0-9A-F]{2})>")


class _Chunks(dict):
    """What follows a space, up to the next, to its ids in both vocabularies with that space."""

    def __init__(self, encoder: PairEncoder) -> None:
        super().__init__()
        self.encoder = encoder

    def __missing__(self, chunk: str) -> tuple[bytes, bytes]:
        got = self.encoder.whole(" " + chunk) if chunk else (self.encoder.a.pieces(" "), np.array([self.encoder.b.piece_to_id(_SPACE)], np.int32).tobytes())
        self[chunk] = got
        return got


class PairEncoder:
    """Ids of both vocabularies for whole texts. most: chunks after which the memo starts anew.

    No piece of either vocabulary has a space after another character, so a space between two characters that aren't white space
    always begins a token in both, and a text's ids are those of its chunks. A vocabulary for which that fails, and texts with
    a space after white space or with the piece vocabulary's own space sign, take the libraries' whole path.
    """

    def __init__(self, a_path: str, b_path: str, most: int = 800_000) -> None:
        from sentencepiece import SentencePieceProcessor

        self.a, self.b, self.most = Encoder(a_path, most), SentencePieceProcessor(model_file=b_path), most
        back = {letter: b for b, letter in _byte_letters().items()}
        vocabulary = self.a.library.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for piece, i in vocabulary.items():
            self.a_bytes[i] = bytes(back[c] for c in piece) if all(c in back for c in piece) else piece.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(m[1], 16)]) if (m := _BYTE.fullmatch(p)) else p.replace(_SPACE, " ").encode() for p in pieces]
        self.a_size, self.b_size = (np.array(list(map(len, x)), np.int32) for x in (self.a_bytes, self.b_bytes))
        self.whole_only = re.compile(f"\\s |{_SPACE}" if not any(_SPACE in p.lstrip(_SPACE) for p in pieces) else "")
        self.chunks = _Chunks(self)

    def whole(self, text: str) -> tuple[bytes, bytes]:
        """Ids of a text that begins with a space; none if either side's bytes aren't the text's."""
        a, b, data = self.a.pieces(text), array("i", self.b.encode(text[1:], num_threads=1)), text.encode()
        if b"".join(map(self.a_bytes.__getitem__, memoryview(a).cast("i"))) != data or b"".join(map(self.b_bytes.__getitem__, b)) != data:
            return b"", b""
        return a, b.tobytes()

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A's ids of space + text and their byte ends, B's ids of text and their byte ends; all empty where a side's bytes differ from space + text, as in an empty text."""
        for kept in (self.chunks, self.a.memo):
            if len(kept) > self.most:
                kept.clear()
        if not text:
            return _NONE
        got = [self.whole(" " + text)] if self.whole_only.search(" " + text) else list(map(self.chunks.__getitem__, text.split(" ")))
        a, b = (np.frombuffer(b"".join(side), np.int32) for side in zip(*got, strict=True))
        a_ends, b_ends, size = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b]), len(text.encode()) + 1
        if not len(a) or not len(b) or a_ends[-1] != size or b_ends[-1] != size:
            return _NONE
        return a, a_ends, b, b_ends


_NONE = (np.empty(0, np.int32),) * 4
_encoders: dict[tuple[str, str], PairEncoder] = {}


def pair_encoder(a_path: str, b_path: str) -> PairEncoder:
    """One for each pair of files in a Python worker; its memo outlives a task."""
    key = (a_path, b_path)
    if key not in _encoders:
        _encoders[key] = PairEncoder(*key)
    return _encoders[key]


def encoded(df: DataFrame, key: str, text: str, a_path: str, b_path: str) -> DataFrame:
    """(key, a, a_ends, b, b_ends): ids and byte ends of every row's text; empty for null and empty texts and where a side's bytes aren't the text's."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = df.schema[key].dataType
    arrow = to_arrow_type(kind)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = pair_encoder(a_path, b_path)
        for batch in slices(batches, 1_000_000):
            found = [enc.encode(t or "") for t in batch.column(1).to_pylist()]
            offsets = [np.concatenate([[0], np.cumsum([len(f[i]) for f in found])]).astype(np.int32) for i in (0, 2)]
            sides = [pa.ListArray.from_arrays(offsets[i // 2], np.concatenate([f[i] for f in found]).astype(np.int32)) for i in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(arrow), *sides], ["key", "a", "a_ends", "b", "b_ends"])

    return df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).mapInArrow(compute, f"key {kind.simpleString()}, a array<int>, a_ends array<int>, b array<int>, b_ends array<int>")


def _events(a: str, b: str) -> Column:
    """Ends of both sides in order, as 4 end + whose: 1 A's, 2 B's, 3 of both."""
    a, b = F.col(a), F.col(b)
    flagged = lambda ends, whose: F.transform(ends, lambda e: e.cast("long") * 4 + whose)
    return F.sort_array(F.concat(flagged(F.array_intersect(a, b), 3), flagged(F.array_except(a, b), 1), flagged(F.array_except(b, a), 2)))


def _flagged(marks: str, whose: int) -> Column:
    return F.filter(marks, lambda m: m.bitwiseAND(whose) != 0)


def _before(marks: str) -> Column:
    return F.slice(marks, 1, F.size(marks) - 1)


def _repeated(ids: str, marks: str) -> Column:
    """Each id as often as events passed since the mark before its own."""
    steps = F.zip_with(F.slice(marks, 2, F.size(marks)), _before(marks), lambda m, before: F.shiftright(m, 2) - F.shiftright(before, 2))
    return F.flatten(F.zip_with(ids, steps, F.array_repeat))


def _grouped(ids: str, marks: str) -> Column:
    """The groups' ids, comma-joined, as an array. A group's first token is told by its sign (id 0 by a number below all others), so that casting, joining and cutting handle whole arrays."""
    signed = F.zip_with(ids, _before(marks), lambda x, m: F.when(m.bitwiseAND(3) != 3, x).when(x == 0, F.lit(_ZERO)).otherwise(-x))
    joined = F.replace(F.array_join(signed.cast("array<string>"), ","), F.lit(str(_ZERO)), F.lit("-0"))
    return F.split(F.substr(joined, F.lit(2)), ",-")


def aligned(tokens: DataFrame) -> DataFrame:
    """tokens of encoded() to (key, n_a, n_b, n_groups, groups, links): groups as one string, links as 2**32 a + b in byte order.

    marks are 4 (number of the event) + whose it is; a_marks those of A's ends, after one for the text's beginning.
    """
    marked = tokens.withColumn("events", _events("a_ends", "b_ends")).withColumn("marks", F.transform("events", lambda e, i: i * 4 + e.bitwiseAND(3).cast("int")))
    for side, whose in (("a", 1), ("b", 2)):
        marked = marked.withColumn(f"{side}_marks", F.concat(F.array(F.lit(-1)), _flagged("marks", whose)))
    groups = F.array_join(F.zip_with(_grouped("a", "a_marks"), _grouped("b", "b_marks"), lambda p, q: F.concat(p, F.lit("|"), q)), ";")
    links = F.zip_with(_repeated("a", "a_marks"), _repeated("b", "b_marks"), lambda a, b: F.shiftleft(a.cast("long"), 32) + b)
    return marked.select(
        "key",
        F.size("a").alias("n_a"),
        F.size("b").alias("n_b"),
        F.size(F.array_intersect("a_ends", "b_ends")).alias("n_groups"),
        F.when(F.size("a") > 0, groups).otherwise("").alias("groups"),
        F.when(F.size("a") > 0, links).otherwise(F.array().cast("array<long>")).alias("links"),
    )


def pair_counts(texts: DataFrame) -> DataFrame:
    """A written table (link, n, best) of aligned()'s rows: how many rows hold an id pair linked, and whether no pair of its A id has more."""
    counts = materialise(texts.select(F.explode(F.array_distinct("links")).alias("link")).groupBy("link").agg(F.count(F.lit(1)).alias("n")), "pair-counts")
    most = counts.groupBy(F.shiftright("link", 32).alias("a")).agg(F.max("n").alias("most"))
    return materialise(counts.withColumn("a", F.shiftright("link", 32)).join(most, "a").select("link", "n", (F.col("n") == F.col("most")).alias("best")), "pairs")


def align(df: DataFrame, key: str, text: str, a_path: str, b_path: str, digest: bool = False, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """One row for each of df's: (key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups).

    Null and empty texts, and texts whose joined A or B bytes differ from space + text, have no tokens: zeros and an empty
    string. digest: the groups' string is its SHA-256 instead (no tokens: still empty). Repeated rows and rows with equal or null keys are rows of their own, and each counts in the pairs' counts; ties for an A
    id's highest count all count as best. An empty table gives an empty one; other columns of df are not read.
    """
    tokens = encoded(df, key, text, a_path, b_path)
    rows = aligned(tokens)
    if digest:  # before it is written
        rows = rows.withColumn("groups", F.when(F.col("groups") != "", F.sha2("groups", 256)).otherwise(""))
    texts = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "aligned", compression="zstd")
    pairs = pair_counts(texts)
    links = texts.select("row", F.explode("links").alias("link"))
    if pairs.count() <= broadcast_pairs:
        met = links.join(F.broadcast(pairs), "link").withColumn("m", F.lit(1))
    else:  # a text's equal links are one row before they meet their counts
        met = links.groupBy("row", "link").agg(F.count(F.lit(1)).alias("m")).join(pairs, "link")
    sums = met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("m")).otherwise(0)).alias("n_best"), F.sum(F.col("m") * F.col("n")).alias("count_sum"))
    own = texts.select("row", "key", "n_a", "n_b", "n_groups", F.size("links").alias("n_links"), "groups")
    none = F.lit(0).cast("long")
    return own.join(sums, "row", "left").select("key", *[F.col(c).cast("long").alias(c) for c in ("n_a", "n_b", "n_groups", "n_links")], F.coalesce("n_best", none).alias("n_best"), F.coalesce("count_sum", none).alias("count_sum"), "groups")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of byte-level and piece tokens of every document; see align() for nulls, empty texts and repeated rows."""
    out = align(documents(spark, sf_dir), "doc_id", "text", tokenizer_path(BYTE_BPE), tokenizer_path(PIECE_BPE), digest=True)
    return out.select(F.col("key").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))
