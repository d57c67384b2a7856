"""Query sets in slices of bounded size, each small enough to go to every task."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import DataFrame, Row

SLICE_ROWS, SLICE_BYTES = 2000, 4 << 20


def _size(row: Row) -> int:
    return sum(8 * len(x) if isinstance(x, (list, str)) else 8 for x in row)


def slices(rows: DataFrame, times: int = 1) -> Iterator[list[Row]]:
    """The rows in lists of at most SLICE_ROWS (times a number) rows and about SLICE_BYTES bytes, one list at a time on the driver."""
    most = SLICE_ROWS * times
    held: list[Row] = []
    size = 0
    first = rows.limit(most + 1).collect()
    for row in first if len(first) <= most else rows.toLocalIterator():
        held.append(row)
        size += _size(row)
        if len(held) == most or size >= SLICE_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def each_slice(rows: DataFrame, run: Callable[[list[Row]], DataFrame], times: int = 1) -> DataFrame:
    """The results of all slices together; without rows, that of an empty slice."""
    return reduce(DataFrame.unionByName, [run(part) for part in slices(rows, times)] or [run([])])
