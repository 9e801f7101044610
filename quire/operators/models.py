"""A seam for models that turn texts into vectors: named, over Arrow batches, and never the reason why a search fails."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators import search as S

#: Characters of a text that a model sees.
SEEN = 4000
Embed = Callable[[list[str]], Sequence[Sequence[float]]]
_models: dict[str, Embed] = {}


def register(name: str, embed: Embed) -> None:
    """Name a model: a function from a list of texts to as many vectors. It is sent to tasks, so it loads what it needs there."""
    _models[name] = embed


def _unit(vector: Sequence[float] | None) -> list[float] | None:
    a = np.asarray(vector if vector is not None else [], np.float64)
    n = np.linalg.norm(a) if a.size and np.isfinite(a).all() else 0.0
    return (a / n).tolist() if n else None


def query_vector(name: str, text: str) -> list[float] | None:
    """A query's vector of length one, or None where there is no such model, it fails, or it gives nothing of a length."""
    try:
        return _unit(_models[name]([text[:SEEN]])[0])
    except Exception:  # noqa: BLE001  # the lexical index still answers
        return None


def embedded(df: DataFrame, key: str, text: str, name: str, batch: int = 64) -> DataFrame:
    """(key, embedding): texts' vectors of length one, by the model in batches. A batch that fails is tried text by text; texts that fail, null and empty ones have null."""
    model = _models[name]

    def one(texts: list[str]) -> list[list[float] | None]:
        try:
            return [_unit(v) for v in model(texts)]
        except Exception:  # noqa: BLE001
            return [None] if len(texts) == 1 else [one([t])[0] for t in texts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            texts = rows.column(1).to_pylist()
            out: list = [None] * len(texts)
            some = [i for i, t in enumerate(texts) if t]
            for at in range(0, len(some), batch):
                for i, v in zip(some[at : at + batch], one([texts[i][:SEEN] for i in some[at : at + batch]]), strict=True):
                    out[i] = v
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(out, pa.list_(pa.float64()))], ["key", "embedding"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, embedding array<double>")


def search(index, text: str, limit: int, mode: str, vectors: DataFrame, name: str, book: str | None = None) -> DataFrame:  # noqa: ANN001
    """A search in a mode with the query's vector from a model; without one, what the mode gives without vectors."""
    q = query_vector(name, text)
    return S.search(index, text, limit, mode, vectors if q else None, q, book)
