"""Tables written to the folder that driver and executors share (see ``operators.lineage``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import dropped, fresh_path, release, shared_dir, temporary, written

__all__ = ["added_up", "dropped", "fresh_path", "release", "shared_dir", "small", "temporary", "written"]


#: Partial tables that one group of :func:`added_up` adds.
FAN = 256


def added_up(parts: DataFrame, add, schema: str) -> DataFrame:
    """One row for each slice from the partial tables (``slice`` and others, written before) of any number of tasks.

    `add` makes one row of the rows of a slice, as often as it takes: tables are added in levels, about FAN in one group.
    """
    most = parts.groupBy("slice").count().agg(F.max("count")).first()[0] or 0
    while most > FAN:
        groups = -(-most // FAN)
        parts = written(parts.withColumn("_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups))).groupBy("slice", "_group").applyInArrow(add, schema), "level")
        most = groups
    return parts.groupBy("slice").applyInArrow(add, schema)


def small(df: DataFrame, rows: int) -> DataFrame:
    """With a broadcast hint if the (already written) frame of a few numbers or digests in each row has at most `rows`
    rows, which bounds its bytes; else as it is: shuffled."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
