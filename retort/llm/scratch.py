"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retort.sources.shared import shared_path as new_path
from retort.sources.shared import stored as written


#: Keys that :func:`with_values` calls hot: those with more rows than this and more than one in HOT_MOST of all rows.
HOT_ROWS, HOT_MOST = 10_000, 1_000


def with_values(rows: DataFrame, values: DataFrame, key: str, count: str) -> DataFrame:
    """Inner join of ``rows`` with ``values``, one row for each key, whose column ``count`` is at least the number of its rows.

    Hot keys are at most HOT_MOST by their definition, so theirs are broadcast and no task
    gets all rows of one; the other keys meet in a shuffle. Both tables are read more than once.
    """
    total = values.agg(F.sum(count)).collect()[0][0] or 0
    hot = values.where(F.col(count) > max(HOT_ROWS, total // HOT_MOST)).drop(count)
    cold = values.where(F.col(count) <= max(HOT_ROWS, total // HOT_MOST)).drop(count)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return rows.join(F.broadcast(hot), key).unionByName(rest)
