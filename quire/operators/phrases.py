"""Dictionary phrases on pages: an Aho-Corasick automaton over words for a dictionary that fits a task, joins by first word for any other."""

from __future__ import annotations

import uuid
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases up to which each task builds the automaton of all.
AUTOMATON_PHRASES = 100_000


class Automaton:
    """Finds all phrases of a dictionary in one pass over a text's words."""

    def __init__(self, phrases: Iterable[tuple[str, object]]) -> None:
        self.steps: list[dict[str, int]] = [{}]
        self.found: list[frozenset] = [frozenset()]
        for phrase, entry in phrases:
            at = 0
            for word in phrase.split(" "):
                if word not in self.steps[at]:
                    self.steps[at][word] = len(self.steps)
                    self.steps.append({})
                    self.found.append(frozenset())
                at = self.steps[at][word]
            if at:
                self.found[at] |= {entry}
        self.back = [0] * len(self.steps)
        queue = deque(self.steps[0].values())
        while queue:  # by depth, so what a state falls back to is finished
            at = queue.popleft()
            for word, then in self.steps[at].items():
                self.back[then] = self._step(self.back[at], word)
                self.found[then] |= self.found[self.back[then]]
                queue.append(then)

    def _step(self, at: int, word: str) -> int:
        while word not in self.steps[at]:
            if not at:
                return 0
            at = self.back[at]
        return self.steps[at][word]

    def entries(self, words: list[str]) -> set:
        first, found, at, out = self.steps[0], self.found, 0, set()
        for word in words:
            at = self._step(at, word) if at else first.get(word, 0)
            if found[at]:
                out |= found[at]
        return out


_built: dict[str, Automaton] = {}


def by_automaton(pages: DataFrame, entries: list[tuple[str, object]], id_type: str) -> DataFrame:
    """(id, book, page) by the automaton of the given (phrase, id) rows, which go to every task once."""
    from pyspark.sql.pandas.types import to_arrow_schema

    sent = pages.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, entries))
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    schema = f"id {id_type}, book {kinds['book']}, page {kinds['page']}"
    arrow = to_arrow_schema(pages.sparkSession.createDataFrame([], schema).schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = sent.value[0]
        if key not in _built:  # a worker builds it once, not once a task
            _built.clear()
            _built[key] = Automaton(sent.value[1])
        automaton = _built[key]
        for batch in batches:
            ids, at = [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                hits = automaton.entries([w for w in text.split(" ") if w]) if text else ()
                ids += hits
                at += [i] * len(hits)
            places = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(ids, arrow.field("id").type), batch.column(0).take(places).cast(arrow.field("book").type), batch.column(1).take(places).cast(arrow.field("page").type)], schema=arrow)

    return pages.select("book", "page", "txt").mapInArrow(scan, schema)


def by_first_words(pages: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(id, book, page) by joins, for a dictionary of any size.

    Each word of a page that begins a phrase meets the lengths of the phrases it begins, and only runs of those lengths meet the dictionary: both
    joins are by equality, on words and on phrases.
    """
    size = F.size(F.split("phrase", " "))
    starts = dictionary.groupBy(F.split("phrase", " ")[0].alias("first")).agg(F.collect_set(size).alias("sizes"), F.max(size).alias("longest"))
    longest = dictionary.agg(F.coalesce(F.max(size), F.lit(1))).first()[0]
    words = F.filter(F.split("txt", " "), lambda w: w != "")
    runs = pages.select("book", "page", words.alias("w")).select("book", "page", F.explode(F.array_distinct(F.transform("w", lambda x, i: F.slice("w", i + 1, longest)))).alias("run"))
    begun = runs.withColumn("first", F.col("run")[0]).join(starts, "first")
    cut = begun.select("book", "page", "run", F.explode("sizes").alias("n")).where(F.col("n") <= F.size("run"))
    return cut.select("book", "page", F.array_join(F.slice("run", F.lit(1), F.col("n")), " ").alias("phrase")).distinct().join(dictionary, "phrase").select("id", "book", "page").distinct()


def found(pages: DataFrame, dictionary: DataFrame, most: int = AUTOMATON_PHRASES) -> DataFrame:
    """(id, book, page) of every dictionary entry (phrase, id) that stands on a page, once each. pages: (book, page, txt), folded, words apart by blanks.

    A page is one row; null and empty pages have no entries, and null or empty phrases stand nowhere.
    """
    dictionary = dictionary.where("trim(phrase) <> ''").select("phrase", "id").distinct()
    some = dictionary.limit(most + 1).collect()
    if len(some) <= most:
        return by_automaton(pages, [(r["phrase"], r["id"]) for r in some], dictionary.schema["id"].dataType.simpleString())
    return by_first_words(pages, dictionary)
