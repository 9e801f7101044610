"""The zip data source: batch and stream, nested archives, restarts."""

import io
import zipfile

from quire.sources import zipped


def archive(path, members):
    with zipfile.ZipFile(path, "w") as z:
        for name, data in members.items():
            z.writestr(name, data)


def test_batch_and_stream_give_the_same_and_a_restart_adds_nothing(spark, tmp_path):
    zipped.register(spark)
    folder = tmp_path / "in"
    folder.mkdir()
    inner = io.BytesIO()
    archive(inner, {"page.txt": "in\nner", "x.xml": "<a/>"})
    archive(folder / "b.zip", {"AF.txt": "one\ntwo\n\nfour", "empty.txt": "", "skip.csv": "no", "deep.zip": inner.getvalue()})
    (folder / "note.txt").write_text("no archive")

    def read(reader):
        return reader.format("zip_lines").option("path", f"file://{folder}").option("members", r"\.txt$").option("nested", "deep").load()

    def stream():
        q = read(spark.readStream).writeStream.option("checkpointLocation", f"{tmp_path}/state").format("parquet").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    want = [("b.zip", "AF.txt", i, v) for i, v in enumerate(["one", "two", "", "four"])] + [("b.zip", "deep.zip/page.txt", 0, "in"), ("b.zip", "deep.zip/page.txt", 1, "ner")]
    df = read(spark.read)
    assert sorted(tuple(r) for r in df.collect()) == sorted(want) and df.rdd.getNumPartitions() == 3
    assert stream() == sorted(want)
    assert stream() == sorted(want)  # nothing new
    archive(folder / "a.zip", {"BG.txt": "\n".join(f"line {i}" for i in range(25_000))})
    want += [("a.zip", "BG.txt", i, f"line {i}") for i in range(25_000)]
    assert stream() == sorted(want) == sorted(tuple(r) for r in read(spark.read).collect())


def test_no_archives(spark, tmp_path):
    zipped.register(spark)
    for path in (tmp_path, tmp_path / "none"):
        assert spark.read.format("zip_lines").option("path", str(path)).load().count() == 0
