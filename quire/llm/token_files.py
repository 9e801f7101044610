"""Token ids as flat unsigned integer files with 64-bit document offsets, written and memory-mapped back.

A data set is a folder with, for each part k: ``k.tokens`` (ids, little-endian, 16 bits where the vocabulary
allows it, else 32), ``k.offsets`` (n + 1 unsigned 64-bit numbers: where each document begins in the part, and
the part's end) and ``k.docs`` (n signed 64-bit document ids). ``manifest.json`` holds the ids' width and, for
each part, its documents, tokens and base: the prefix sum of the tokens before it. A document's place in the
whole is base + offset.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm._common import documents, new_path, slices
from quire.llm.encoding import BYTE_BPE, encoder, tokenizer_path

#: Texts' characters that one part takes, at most by the key ranges' evenness.
PART_CHARS = 16_000_000
#: Entries of each of the encoder's two memos in a worker, some 200 bytes each.
MEMO = 1_000_000
_RESULT = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def _put(files, path: str, data: bytes | memoryview) -> None:
    with files.open_output_stream(path) as out:
        out.write(data)


def _mapped(files, path: str, kind: str) -> np.ndarray:
    """An array over the file: memory-mapped on a shared mount, read by stream from other stores."""
    from pyarrow import fs

    if isinstance(files, fs.LocalFileSystem):
        return np.memmap(path, dtype=kind, mode="r") if files.get_file_info(path).size else np.empty(0, kind)
    with files.open_input_stream(path) as f:
        return np.frombuffer(f.read(), kind)


def write(df: DataFrame, key: str, text: str, path: str, vocabulary: str, end_id: int = 0, parts: int | None = None) -> dict:
    """Encode each text, append end_id, and write the files in ascending key order; returns the manifest.

    Keys are dealt by range, so part k holds smaller keys than part k + 1, and each part is sorted. A part's
    file is written under an attempt's name and then moved into place: a repeated or speculative task puts the
    same bytes there again. Null texts count as empty, null keys come first and are kept as the smallest
    64-bit integer; rows with the same key are ordered by their text. An empty table gives a manifest of no parts.
    """
    rows = df.select(F.coalesce(F.col(key).cast("long"), F.lit(-(2**63)).cast("long")).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    if parts is None:
        chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
        parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-chars // PART_CHARS))
    ordered = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task = encoder(vocabulary, MEMO), TaskContext.get()
        kind = "<u2" if enc.library.get_vocab_size() <= 65536 else "<u4"
        end, k = np.array([end_id], "<u4").tobytes(), task.partitionId()
        files, root = _filesystem(path)
        files.create_dir(root, recursive=True)
        part = f"{root}/{k:06d}"
        attempt = f"{part}.{task.taskAttemptId()}"
        ids, sizes, total = [], [0], 0
        with files.open_output_stream(f"{attempt}.tokens") as out:
            for batch in slices(batches):
                for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    got = np.frombuffer(enc.encode_bytes(body) + end, "<u4")
                    out.write(got.astype(kind).tobytes())
                    total += len(got)
                    ids.append(doc)
                    sizes.append(total)
        _put(files, f"{attempt}.offsets", np.array(sizes, "<u8").tobytes())
        _put(files, f"{attempt}.docs", np.array(ids, "<i8").tobytes())
        for name in ("tokens", "offsets", "docs"):
            files.move(f"{attempt}.{name}", f"{part}.{name}")
        yield pa.RecordBatch.from_pydict({"part": [k], "documents": [len(ids)], "tokens": [total], "width": [int(kind[2:])]})

    found = ordered.mapInArrow(encode, "part long, documents long, tokens long, width long").collect()  # one row a part
    base, manifest = 0, {"width": max((r["width"] for r in found), default=2), "parts": []}
    for r in sorted(found):
        manifest["parts"].append({"part": r["part"], "documents": r["documents"], "tokens": r["tokens"], "base": base})
        base += r["tokens"]
    files, root = _filesystem(path)
    files.create_dir(root, recursive=True)
    _put(files, f"{root}/manifest.json", json.dumps(manifest).encode())
    return manifest


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row for each document in the files: its id, start in the whole, length, and crc32 of its ids as 32-bit integers."""
    files, root = _filesystem(path)
    with files.open_input_stream(f"{root}/manifest.json") as f:
        manifest = json.loads(f.read())
    parts, kind = [p for p in manifest["parts"] if p["documents"]], f"<u{manifest['width']}"
    if not parts:
        return spark.createDataFrame([], _RESULT)
    listed = spark.createDataFrame([(i, p["part"], p["base"]) for i, p in enumerate(parts)], "i int, part int, base long")

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _filesystem(path)
        for batch in batches:
            for part, base in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                tokens, offsets, docs = (_mapped(files, f"{root}/{part:06d}.{n}", t) for n, t in (("tokens", kind), ("offsets", "<u8"), ("docs", "<i8")))
                for at in range(0, len(docs), 10_000):
                    some, edges = docs[at : at + 10_000], offsets[at : at + 10_001].astype(np.int64)
                    crc = [zlib.crc32(tokens[a:b].astype("<u4").tobytes()) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(some)), pa.array(edges[:-1] + base), pa.array(np.diff(edges)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return listed.repartitionById(len(parts), F.col("i")).mapInArrow(load, _RESULT)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids as the files give them back, in ascending order of id; null texts are the end id alone."""
    path = new_path(spark, "tokens")
    write(documents(spark, sf_dir), "doc_id", "text", path, tokenizer_path(BYTE_BPE))
    return read(spark, path)
