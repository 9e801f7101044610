"""A search index that grows: segments of pages under a log of commits, merged by size; later pages take the place of earlier ones of their id.

Each addition is written as a segment of its own, in the form of the stored index, and committed with one small file, so its cost is that of its
pages. A page added again, or removed, leaves a tombstone in the segments before: its id with the number from which on it holds. Readers
leave out what tombstones name, and count terms and lengths over what is left, so a search gives what a fresh index of the pages
would. When enough segments of about a size have gathered they are written into one.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import index as I
from quire.operators import search as S
from quire.sources.snapshots import Commits, Conflict

#: Segments of one size class (powers of MERGE pages) that are merged into one.
MERGE = 8


@dataclass(frozen=True)
class GrowingIndex:
    """The index of a folder that driver and executors share. Pages are (id, book, page, raw); ids aren't null."""

    spark: SparkSession
    path: str

    def _log(self) -> Commits:
        return Commits(self.spark, f"{self.path}/log")

    def segments(self) -> list[dict]:
        """The live segments: what the last commit lists. Tens, however many additions there were."""
        return self._log().latest().get("segments", [])

    def add(self, pages: DataFrame, token: str) -> int:
        """Add pages, in place of those that have their ids; returns the version. A token that the log holds is a replay and adds nothing."""
        return self._put(pages, pages.select("id"), token)

    def remove(self, ids: DataFrame, token: str) -> int:
        """Remove the pages of ids(id)."""
        return self._put(None, ids.select("id"), token)

    def _put(self, pages: DataFrame | None, ids: DataFrame, token: str) -> int:
        log = self._log()
        if (done := log.version_of(token)) is not None:
            return done
        name = f"segments/{uuid.uuid4().hex}"
        ids.where("id IS NOT NULL").distinct().write.parquet(f"{self.path}/{name}/replaced")
        n = 0
        if pages is not None:
            I.build(pages.where("id IS NOT NULL").dropDuplicates(["id"]), f"{self.path}/{name}")
            n = self.spark.read.parquet(f"{self.path}/{name}/stats").first()["n"]
        while True:
            last = log.latest()
            version = last.get("version", -1) + 1
            try:
                log.commit(version, token, segments=[*last.get("segments", []), {"name": name, "pages": n, "born": version}])
                return version
            except Conflict:
                if (done := log.version_of(token)) is not None:
                    return done

    def _dead(self, segments: list[dict]) -> DataFrame:
        """(id, until): the latest version that replaced or removed an id."""
        parts = [self.spark.read.parquet(f"{self.path}/{s['name']}/replaced").select("id", F.lit(s["born"]).cast("long").alias("until")) for s in segments]
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out.groupBy("id").agg(F.max("until").alias("until"))

    def _live(self, segments: list[dict], what: str, columns: list[str]) -> DataFrame:
        """Rows of the segments that no later segment replaces. The last segment's rows need no look at tombstones."""
        stored = lambda s: self.spark.read.parquet(f"{self.path}/{s['name']}/{what}")
        read = lambda s: (S.unblocked(stored(s)) if what == "postings" else stored(s)).select(*columns, F.lit(s["born"]).cast("long").alias("born"))
        held = [s for s in segments if s["pages"]]
        if not held:
            return self.spark.createDataFrame([], "id long, book string, page long, raw string, txt string" if what == "pages" else "term string, id long, tf long, dl int").select(*columns)
        old = None
        for s in held:
            old = read(s) if old is None else old.union(read(s))
        dead = self._dead(segments).withColumnRenamed("id", "d")
        return old.join(dead, (F.col("id") == F.col("d")) & (F.col("until") > F.col("born")), "left_anti").select(*columns)

    def open(self) -> I.SearchIndex:
        """The index as it is, for the searches of quire.operators.search."""
        segments = self.segments()
        pages = self._live(segments, "pages", ["id", "book", "page", "raw", "txt"])
        posted = self._live(segments, "postings", ["term", "id", "tf", "dl"])
        stats = S.lengths(pages).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")).first()
        return I.SearchIndex(pages, posted, S.vocabulary(posted), stats["n"], stats["avgdl"] or 0.0)

    def merge(self) -> bool:
        """Write segments into one where a run of neighbours of one size class has grown to MERGE; returns whether there was one.

        Only neighbours are merged, so that what replaces what stays as it was. Another writer's commit meanwhile makes it do nothing.
        """
        log = self._log()
        last = log.latest()
        segments = last.get("segments", [])
        size = lambda s: len(f"{max(s['pages'], 1):o}")  # noqa: E731  # octal digits: powers of 8
        for i in range(len(segments) - MERGE + 1):
            some = segments[i : i + MERGE]
            if len({size(s) for s in some}) > 1:
                continue
            name = f"segments/{uuid.uuid4().hex}"
            ids = self._dead(some).select("id")
            ids.write.parquet(f"{self.path}/{name}/replaced")
            for what, key, columns in (("pages", "id", ["id", "book", "page", "raw", "txt"]), ("postings", "term", ["term", "id", "tf", "dl"])):
                I.sorted_files(self._live(some, what, columns), key, f"{self.path}/{name}/{what}")
            n = self.spark.read.parquet(f"{self.path}/{name}/pages").count()
            try:
                log.commit(last["version"] + 1, f"merge-{name}", segments=[*segments[:i], {"name": name, "pages": n, "born": some[-1]["born"]}, *segments[i + MERGE :]])
            except Conflict:
                return False
            return True
        return False
