"""Lines of zip archives' members as a data source, in batch and as a stream: a partition for each member, read as it is decompressed.

    register(spark)
    spark.read.format("zip_lines").option("path", folder_or_file).option("members", r"\\.txt$").load()
    spark.readStream.format("zip_lines")...  # archives that come later are read once each

Rows are (archive, member, line, value): the archive's file name, the member's name, the line's number from 0 and its text. Lines end with a
newline; undecodable bytes are replaced. A zip within a zip is read through if its own name matches ``nested`` (default: none).
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

_SCHEMA = pa.schema([("archive", pa.string()), ("member", pa.string()), ("line", pa.int64()), ("value", pa.string())])
_LINES = 10_000


@dataclass
class Member(InputPartition):
    """A member of an archive; within: the names of the zips that lead to it."""

    archive: str
    within: tuple[str, ...]
    name: str


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


class _Archives:
    """What both readers share: the archives of a path, their members, and a member's rows."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.members, self.nested = options["path"], options.get("members", ""), options.get("nested")

    def archives(self) -> list[tuple[int, str]]:
        """(time in nanoseconds, path) of each archive in order. A missing path has none."""
        from pyarrow import fs

        files, root = _filesystem(self.path)
        info = files.get_file_info(root)
        found = files.get_file_info(fs.FileSelector(root)) if info.type == fs.FileType.Directory else [info]
        return sorted((f.mtime_ns or 0, f.path) for f in found if f.type == fs.FileType.File and f.path.lower().endswith(".zip"))

    def parts(self, archives: list[str]) -> list[Member]:
        """The members of archives whose names match. Only directories are read for it."""
        out = []
        for archive in archives:
            with _filesystem(self.path)[0].open_input_file(archive) as f:
                out += self._listed(archive, (), f)
        return out

    def _listed(self, archive: str, within: tuple[str, ...], f) -> Iterator[Member]:
        with zipfile.ZipFile(f) as z:
            for name in z.namelist():
                if self.nested and name.lower().endswith(".zip") and re.search(self.nested, name):
                    yield from self._listed(archive, (*within, name), io.BytesIO(z.read(name)))
                elif not name.endswith("/") and re.search(self.members, name):
                    yield Member(archive, within, name)

    def rows(self, part: Member) -> Iterator[pa.RecordBatch]:
        with _filesystem(self.path)[0].open_input_file(part.archive) as f:
            z = zipfile.ZipFile(f)
            for name in part.within:
                z = zipfile.ZipFile(io.BytesIO(z.read(name)))
            archive, name, n, held = part.archive.rpartition("/")[2], "/".join((*part.within, part.name)), 0, []
            with z.open(part.name) as lines:
                for line in lines:
                    held.append(line.removesuffix(b"\n").decode("utf-8", "replace"))
                    if len(held) == _LINES:
                        yield self._batch(archive, name, n, held)
                        n, held = n + len(held), []
            if held:
                yield self._batch(archive, name, n, held)

    @staticmethod
    def _batch(archive: str, name: str, n: int, held: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([archive] * len(held)), pa.array([name] * len(held)), pa.array(range(n, n + len(held)), pa.int64()), pa.array(held)], schema=_SCHEMA)


class _Batch(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.of = _Archives(options)

    def partitions(self) -> list[Member]:
        # Spark asks for at least one partition
        return self.of.parts([p for _, p in self.of.archives()]) or [Member("", (), "")]

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        if partition.archive:
            yield from self.of.rows(partition)


class _Stream(DataSourceStreamReader):
    """The offset is the time and path of the last archive: archives are taken in that order, each once."""

    def __init__(self, options: dict[str, str]) -> None:
        self.of = _Archives(options)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        archives = self.of.archives()
        return {"time": archives[-1][0], "path": archives[-1][1]} if archives else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Member]:
        low, high = ((o["time"], o["path"]) for o in (start, end))
        return self.of.parts([a[1] for a in self.of.archives() if low < a <= high]) or [Member("", (), "")]

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        if partition.archive:
            yield from self.of.rows(partition)


class ZipLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zip_lines"

    def schema(self) -> str:
        return "archive string, member string, line long, value string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Batch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: ANN001, N802
        return _Stream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ZipLines)
