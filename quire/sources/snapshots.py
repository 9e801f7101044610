"""Tables of Parquet files that take updates: each change is a folder of rows and one commit file, and readers merge them.

A commit is one small JSON file under the next version's number, renamed into place, which fails if the number is
taken; so of two writers one commits and the other tries the number after. What no commit names is invisible: a writer that died
before its commit changed nothing. A change carries a token; a change whose token is in the log is a replay and does nothing.

Updates are kept as they came, with the columns that they set, and each column takes its latest value as rows are read
(merge on read). compact() writes the rows as they are read and commits them as the new beginning; older versions stay readable.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOG = "version long, token string, kind string, folder string, columns array<string>"


class Conflict(Exception):
    """The version's number is taken."""


def put_if_absent(spark: SparkSession, path: str, folder: str, data: bytes) -> None:
    """Write a small file of the driver's at path by a rename that doesn't replace one, or raise Conflict. folder: for the try."""
    jvm = spark._jvm
    at, new = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{folder}/{uuid.uuid4().hex}"))
    conf = spark._jsc.hadoopConfiguration()
    fs = at.getFileSystem(conf)
    fs.mkdirs(at.getParent())
    out = fs.create(new, False)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    keep = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    keep[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), conf).rename(new, at, keep)
    except Exception as e:
        if "FileAlreadyExists" not in str(e):
            raise
        fs.delete(new, False)
        raise Conflict(path) from e


@dataclass(frozen=True)
class Commits:
    """A log whose every commit holds a whole state, as one JSON line; its number is taken by one writer only."""

    spark: SparkSession
    path: str

    def _lines(self) -> DataFrame:
        try:
            return self.spark.read.schema("value string").text(f"{self.path}/commits").select("value", F.get_json_object("value", "$.version").cast("long").alias("version"), F.get_json_object("value", "$.token").alias("token"))
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], "value string, version long, token string")

    def latest(self) -> dict:
        """The last state, {} before any."""
        row = self._lines().agg(F.max_by("value", "version").alias("v")).first()
        return json.loads(row["v"]) if row["v"] else {}

    def version_of(self, token: str) -> int | None:
        return self._lines().where(F.col("token") == token).agg(F.min("version")).first()[0]

    def commit(self, version: int, token: str, **state: object) -> None:
        put_if_absent(self.spark, f"{self.path}/commits/{version:012d}.json", f"{self.path}/tries", json.dumps({"version": version, "token": token, **state}).encode())


@dataclass(frozen=True)
class SnapshotTable:
    """A table in a folder that driver and executors share. key names its rows; schema is that of its rows, as a DDL string."""

    spark: SparkSession
    path: str
    key: str
    schema: str

    def _log(self) -> DataFrame:
        try:
            return self.spark.read.schema(_LOG).json(f"{self.path}/commits")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], _LOG)

    def version(self) -> int:
        """The latest version; -1 before any commit."""
        return self._log().agg(F.coalesce(F.max("version"), F.lit(-1))).first()[0]

    def commit(self, version: int, token: str, kind: str, folder: str, columns: list[str]) -> None:
        """Put a version's commit file in place, or raise Conflict."""
        put_if_absent(self.spark, f"{self.path}/commits/{version:012d}.json", f"{self.path}/tries", json.dumps({"version": version, "token": token, "kind": kind, "folder": folder, "columns": columns}).encode())

    def _change(self, kind: str, rows: DataFrame, token: str, at: int | None = None) -> int:
        """Write rows and commit them. Returns the version that holds the token's change, be it this one or that of an earlier try."""
        done = self._log().where(F.col("token") == token).agg(F.min("version")).first()[0]
        if done is not None:
            return done
        folder = f"data/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        while True:
            version = self.version() + 1 if at is None else at
            try:
                self.commit(version, token, kind, folder, rows.columns)
                return version
            except Conflict:
                if at is not None:
                    raise
                done = self._log().where(F.col("token") == token).agg(F.min("version")).first()[0]
                if done is not None:
                    return done

    def insert(self, rows: DataFrame, token: str) -> int:
        """Add rows, whose keys must be new: a key that the table holds has two rows from then on."""
        return self._change("rows", rows.select(*self.spark.createDataFrame([], self.schema).columns), token)

    def update(self, changes: DataFrame, order: list[str], token: str) -> int:
        """Set the columns of changes (the key and some of the table's) in rows with its keys. Of changes to one key the last by order counts.

        Keys without a row, and null keys, change nothing; a null sets a null.
        """
        columns = [c for c in changes.columns if c != self.key and c not in order]
        last = changes.where(F.col(self.key).isNotNull()).groupBy(self.key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("new"))
        return self._change("changes", last.select(self.key, "new.*"), token)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows as of a version (default: the latest). A change counts for rows that were there when it was committed."""
        log = self._log()
        upto = log if version is None else log.where(F.col("version") <= version)
        began = upto.where("kind = 'whole'").agg(F.coalesce(F.max("version"), F.lit(-1))).first()[0]
        entries = upto.where(F.col("version") >= began).orderBy("version").collect()  # since the last compaction
        empty = self.spark.createDataFrame([], self.schema)
        rows, changes = empty.withColumn("__since", F.lit(0).cast("long")), None
        for e in entries:
            part = self.spark.read.parquet(f"{self.path}/{e['folder']}")
            v = F.lit(e["version"]).cast("long")
            if e["kind"] != "changes":
                rows = rows.union(part.withColumn("__since", v))
            else:
                part = part.select(self.key, *[F.struct(v.alias("v"), F.col(c).alias("x")).alias(c) for c in part.columns if c != self.key])
                changes = part if changes is None else changes.unionByName(part, allowMissingColumns=True)
        if changes is None:
            return rows.drop("__since")
        own = [c for c in changes.columns if c != self.key]
        latest = changes.groupBy(F.col(self.key).alias("__key")).agg(*[F.max_by(c, F.col(c)["v"]).alias(f"__{c}") for c in own])
        met = rows.join(latest, rows[self.key] == F.col("__key"), "left")
        return met.select(*[F.when(F.col(f"__{c}")["v"] > F.col("__since"), F.col(f"__{c}")["x"]).otherwise(F.col(c)).alias(c) if c in own else F.col(c) for c in empty.columns])

    def compact(self) -> int:
        """Commit the rows as they are as a new beginning. A change that another writer commits meanwhile makes it fail with Conflict: it then holds."""
        now = self.version()
        return self._change("whole", self.read(now), f"compact-{uuid.uuid4().hex}", now + 1)
