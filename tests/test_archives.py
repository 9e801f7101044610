"""Archives written by tasks against the standard library's reader."""

import random
import zipfile
import zlib

from quire.sources import archives


def test_combined_checksums():
    rnd = random.Random(1)
    for _ in range(50):
        a, b = (rnd.randbytes(rnd.randrange(300)) for _ in range(2))
        assert archives.combined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_whole_archive(spark, tmp_path):
    rnd = random.Random(2)
    want = {f"data/é{i}.txt": [rnd.randbytes(rnd.randrange(2000)) for _ in range(rnd.randint(1, 9))] for i in range(80)} | {"empty": [b""], "null": [None], "long.bin": [bytes([i % 251]) * 50_000 for i in range(40)]}
    rows = [(n, seq * 3, d) for n, parts in want.items() for seq, d in enumerate(parts)]
    df = spark.createDataFrame(rows, "name string, seq long, data binary").repartition(7)
    size = archives.write_zip(df, f"file://{tmp_path}/z", f"file://{tmp_path}/w")
    archives.joined(spark, f"file://{tmp_path}/z", f"file://{tmp_path}/all.zip")
    assert (tmp_path / "all.zip").stat().st_size == size
    with zipfile.ZipFile(tmp_path / "all.zip") as z:
        assert z.testzip() is None and z.namelist() == sorted(want, key=str.encode)
        assert {n: z.read(n) for n in z.namelist()} == {n: b"".join(p or b"" for p in parts) for n, parts in want.items()}
    listed = {r["name"]: (r["size"], r["crc32"]) for r in archives.listed(spark, f"file://{tmp_path}/z").collect()}
    assert listed == {n: (len(d := b"".join(p or b"" for p in parts)), zlib.crc32(d)) for n, parts in want.items()}


def test_empty_archive(spark, tmp_path):
    archives.write_zip(spark.createDataFrame([], "name string, seq long, data binary"), f"file://{tmp_path}/z", f"file://{tmp_path}/w")
    archives.joined(spark, f"file://{tmp_path}/z", f"file://{tmp_path}/all.zip")
    assert zipfile.ZipFile(tmp_path / "all.zip").namelist() == [] and archives.listed(spark, f"file://{tmp_path}/z").count() == 0


def test_records_beyond_32_bits(tmp_path):
    """A directory whose numbers need zip64 is read back by the standard library."""
    import io
    import struct

    big = 5 << 30
    entry, end = archives.directory_entry(b"x", 1, big, big + 1, big + 2), archives.end_record(70_000, 100, big)
    assert struct.unpack("<HHQQQ", entry[-28:]) == (1, 24, big + 1, big, big + 2)
    assert struct.unpack("<HHQQ", archives.local_header(b"x", 1, big, big + 1)[-20:]) == (1, 16, big + 1, big)
    assert struct.unpack("<QQQQ", end[24:56]) == (70_000, 70_000, 100, big)
    assert zipfile._EndRecData(io.BytesIO(archives.end_record(0, 0, 0)))[zipfile._ECD_ENTRIES_TOTAL] == 0
