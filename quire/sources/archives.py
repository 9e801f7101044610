"""Zip archives of any size, written by tasks: files come in pieces, and a file may be longer than what one task writes.

Pieces are compressed apart, each ended by a flush, so that a file's pieces follow each other as one deflate stream; its checksum is
combined from theirs. With sizes and checksums known, tasks write segments of the archive in the order of names; then the central
directory with offsets from the segments' prefix sums; then the end record. Segments in the order of their names are the archive:
``joined`` puts them into one file. Numbers beyond 32 bits are written as zip64.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed values of the format: signatures, versions, flag for UTF-8 names, deflate, the least date.
LOCAL, ENTRY, END64, WHERE64, END = 0x04034B50, 0x02014B50, 0x06064B50, 0x07064B50, 0x06054B50
VERSION, UTF8, DEFLATE, DATE, FULL = 45, 1 << 11, 8, 33, 0xFFFFFFFF
_PIECE = "name string, seq long, body binary, crc long, size long, packed long"


def combined(one: int, two: int, size: int) -> int:
    """The CRC-32 of two byte strings together, from their own and the second's size: shifting by a zero byte is a linear map, squared for each bit of the size."""
    rows = [0xEDB88320, *(1 << i for i in range(31))]  # one zero bit
    apply = lambda m, v: _xor(m[i] for i in range(32) if v >> i & 1)
    square = lambda m: [apply(m, r) for r in m]
    for _ in range(3):
        rows = square(rows)
    while size:
        if size & 1:
            one = apply(rows, one)
        size >>= 1
        if size:
            rows = square(rows)
    return one ^ two


def _xor(values: Iterator[int]) -> int:
    out = 0
    for v in values:
        out ^= v
    return out


def _wide(*numbers: int) -> tuple[list[int], bytes]:
    """Numbers for 32-bit fields, and the zip64 field with those that need more."""
    more = [n for n in numbers if n >= FULL]
    return [min(n, FULL) for n in numbers], struct.pack(f"<HH{len(more)}Q", 1, 8 * len(more), *more) if more else b""


def local_header(name: bytes, crc: int, packed: int, size: int) -> bytes:
    extra = struct.pack("<HHQQ", 1, 16, size, packed) if max(size, packed) >= FULL else b""
    p, s = (FULL, FULL) if extra else (packed, size)
    return struct.pack("<IHHHHHIIIHH", LOCAL, VERSION, UTF8, DEFLATE, 0, DATE, crc, p, s, len(name), len(extra)) + name + extra


def directory_entry(name: bytes, crc: int, packed: int, size: int, offset: int) -> bytes:
    (s, p, o), extra = _wide(size, packed, offset)
    return struct.pack("<IHHHHHHIIIHHHHHII", ENTRY, 3 << 8 | VERSION, VERSION, UTF8, DEFLATE, 0, DATE, crc, p, s, len(name), len(extra), 0, 0, 0, 0o644 << 16, o) + name + extra


def end_record(entries: int, size: int, offset: int) -> bytes:
    wide = struct.pack("<IQHHIIQQQQ", END64, 44, 3 << 8 | VERSION, VERSION, 0, 0, entries, entries, size, offset) + struct.pack("<IIQI", WHERE64, 0, offset + size, 1)
    n = min(entries, 0xFFFF)
    return (wide if entries >= 0xFFFF or max(size, offset) >= FULL else b"") + struct.pack("<IHHHHIIH", END, 0, 0, n, n, min(size, FULL), min(offset, FULL), 0)


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def _compressed(pieces: DataFrame) -> DataFrame:
    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, seqs, data, last = (c.to_pylist() for c in batch.columns)
            for name, seq, body, ends in zip(names, seqs, data, last, strict=True):
                z = zlib.compressobj(6, zlib.DEFLATED, -15)
                packed = z.compress(body or b"") + z.flush(zlib.Z_FINISH if ends else zlib.Z_FULL_FLUSH)
                yield pa.RecordBatch.from_pydict({"name": [name], "seq": [seq], "body": [packed], "crc": [zlib.crc32(body or b"")], "size": [len(body or b"")], "packed": [len(packed)]})

    most = pieces.groupBy(F.col("name").alias("n")).agg(F.max("seq").alias("most"))
    rows = pieces.join(most, F.col("name") == F.col("n")).select("name", "seq", "data", (F.col("seq") == F.col("most")).alias("last"))
    return rows.mapInArrow(compress, _PIECE)


def _totals(packed: DataFrame) -> DataFrame:
    """(file, crc, size, packed, first) of each file, from its pieces in order; pieces stream past."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        out = lambda h: pa.RecordBatch.from_pydict({k: [v] for k, v in zip(("file", "crc_all", "size_all", "packed_all", "first"), h, strict=True)})
        for batch in batches:
            for name, seq, crc, size, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0] == name:
                    held = [name, combined(held[1], crc, size), held[2] + size, held[3] + n, held[4]]
                else:
                    if held:
                        yield out(held)
                    held = [name, crc, size, n, seq]
        if held:
            yield out(held)

    rows = packed.select("name", "seq", "crc", "size", "packed").repartition("name").sortWithinPartitions("name", "seq")
    return rows.mapInArrow(fold, "file string, crc_all long, size_all long, packed_all long, first long")


def write_zip(pieces: DataFrame, path: str, work: str) -> int:
    """Write pieces (name, seq, data binary) under path as segments of one archive; returns its size in bytes.

    Files come in the order of their names by bytes, a file's pieces by seq, which must differ within it; null data are empty. work is a folder for what is
    written between, both shared with the tasks. A segment is written under an attempt's name and moved into place, so a repeated task
    does no harm. A table without pieces gives an empty archive.
    """
    spark = pieces.sparkSession
    _compressed(pieces.select("name", "seq", "data")).write.parquet(f"{work}/packed")
    packed = spark.read.schema(_PIECE).parquet(f"{work}/packed")
    _totals(packed).write.parquet(f"{work}/totals")
    totals = spark.read.schema("file string, crc_all long, size_all long, packed_all long, first long").parquet(f"{work}/totals")
    rows = packed.join(totals, F.col("name") == F.col("file")).select("name", "seq", "body", "crc_all", "size_all", "packed_all", (F.col("seq") == F.col("first")).alias("begins"))

    def segments(kind: str):
        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            files, root = _filesystem(path)
            files.create_dir(root, recursive=True)
            task = TaskContext.get()
            part, at, entries = f"{root}/{kind}-{task.partitionId():06d}", 0, []
            with files.open_output_stream(f"{part}.{task.taskAttemptId()}") as out:
                for batch in batches:
                    for row in batch.to_pylist():
                        name = row["name"].encode()
                        if kind == "1-directory":
                            data = directory_entry(name, row["crc_all"], row["packed_all"], row["size_all"], row["offset"])
                        else:
                            data = (local_header(name, row["crc_all"], row["packed_all"], row["size_all"]) if row["begins"] else b"") + row["body"]
                            if row["begins"]:
                                entries.append((row["name"], at))
                        out.write(data)
                        at += len(data)
                    for i in range(0, len(entries), 10_000):
                        yield pa.RecordBatch.from_pydict({"segment": [task.partitionId()] * len(entries[i : i + 10_000]), "bytes": [None] * len(entries[i : i + 10_000]), "file": [e[0] for e in entries[i : i + 10_000]], "at": [e[1] for e in entries[i : i + 10_000]]}, schema=_PLACES)
                    entries = []
            files.move(f"{part}.{task.taskAttemptId()}", part)
            yield pa.RecordBatch.from_pydict({"segment": [task.partitionId()], "bytes": [at], "file": [None], "at": [None]}, schema=_PLACES)

        return write

    places = "segment int, bytes long, file string, at long"
    rows.repartitionByRange("name", "seq").sortWithinPartitions("name", "seq").mapInArrow(segments("0-data"), places).write.parquet(f"{work}/places")
    found = spark.read.schema(places).parquet(f"{work}/places")
    sizes = found.where("file IS NULL").select("segment", "bytes")  # a row a segment
    bases = sizes.select("segment", (F.sum("bytes").over(Window.orderBy("segment")) - F.col("bytes")).alias("base"))
    entries = found.where("file IS NOT NULL").join(F.broadcast(bases), "segment").select(F.col("file").alias("name"), (F.col("base") + F.col("at")).alias("offset")).join(totals, F.col("name") == F.col("file"))
    entries.select("name", "offset", "crc_all", "packed_all", "size_all").write.parquet(f"{work}/entries")
    listed = spark.read.parquet(f"{work}/entries")
    listed.repartitionByRange("name").sortWithinPartitions("name").mapInArrow(segments("1-directory"), places).write.parquet(f"{work}/directory")
    count, data = listed.count(), sizes.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    directory = spark.read.schema(places).parquet(f"{work}/directory").agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    files, root = _filesystem(path)
    files.create_dir(root, recursive=True)
    end = end_record(count, directory, data)
    with files.open_output_stream(f"{root}/2-end") as out:
        out.write(end)
    return data + directory + len(end)


_PLACES = pa.schema([("segment", pa.int32()), ("bytes", pa.int64()), ("file", pa.string()), ("at", pa.int64())])


def digests(pieces: DataFrame) -> DataFrame:
    """(name, sha256) of files in pieces (name, seq, data): pieces stream through their file's digest in order."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, running = None, None
        for batch in batches:
            for n, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if running is None or n != name:
                    if running is not None:
                        yield pa.RecordBatch.from_pydict({"name": [name], "sha256": [running.hexdigest()]})
                    name, running = n, hashlib.sha256()
                running.update(data or b"")
        if running is not None:
            yield pa.RecordBatch.from_pydict({"name": [name], "sha256": [running.hexdigest()]})

    return pieces.select("name", "seq", "data").repartition("name").sortWithinPartitions("name", "seq").mapInArrow(digest, "name string, sha256 string")


def segments(path: str) -> list[str]:
    """An archive's segments in order."""
    from pyarrow import fs

    files, root = _filesystem(path)
    return sorted(f.path for f in files.get_file_info(fs.FileSelector(root)) if f.base_name[:2] in ("0-", "1-", "2-") and f.base_name.count(".") == 0)


def joined(spark: SparkSession, path: str, target: str) -> None:
    """One file of the segments. A file has one writer: one task streams them through, some megabytes at a time."""

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files, to = _filesystem(target)
            files.create_dir(to.rpartition("/")[0], recursive=True)
            attempt = f"{to}.{uuid.uuid4().hex}"
            with files.open_output_stream(attempt) as out:
                for part in segments(path):
                    with _filesystem(path)[0].open_input_stream(part) as f:
                        while data := f.read(8 << 20):
                            out.write(data)
            files.move(attempt, to)
            yield batch

    spark.range(1).coalesce(1).mapInArrow(copy, "id long").collect()


def listed(spark: SparkSession, path: str) -> DataFrame:
    """(name, crc32, packed, size, offset) of an archive's files, read from the segments of its central directory, a task each."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = _filesystem(path)
        for part in (p for b in batches for p in b.column(0).to_pylist()):
            with files.open_input_stream(part) as f:
                while head := f.read(46):
                    crc, packed, size, n, extra = struct.unpack("<IIIHH", head[16:32])
                    (offset,) = struct.unpack("<I", head[42:46])
                    name, more = f.read(n).decode(), f.read(extra)
                    wide = iter(struct.unpack(f"<{max(0, len(more) - 4) // 8}Q", more[4:]))
                    size, packed, offset = (next(wide) if x == FULL else x for x in (size, packed, offset))
                    yield pa.RecordBatch.from_pydict({"name": [name], "crc32": [crc], "packed": [packed], "size": [size], "offset": [offset]})

    schema = "name string, crc32 long, packed long, size long, offset long"
    parts = [(p,) for p in segments(path) if "/1-directory-" in p]
    return spark.createDataFrame(parts, "part string").repartition(max(1, len(parts))).mapInArrow(parse, schema) if parts else spark.createDataFrame([], schema)
