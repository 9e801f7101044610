"""Rows in order for a consumer that takes them one by one, such as a download."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row

#: Rows of a range, about.
ROWS = 20_000


def ordered_rows(df: DataFrame, *order: str, rows: int = ROWS) -> Iterator[Row]:
    """df's rows in order, a key range at a time: the driver holds one range and the next one, which is read meanwhile.

    Ranges are computed as the consumer comes to them, so one that stops early costs little more than what it took. Rows with equal keys are of one range.
    """
    parts = max(1, -(-df.count() // rows))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return ranged.toLocalIterator(prefetchPartitions=True)
