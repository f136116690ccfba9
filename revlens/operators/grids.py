"""Zero-filled result grids and size-checked broadcasts.

A result grid (12 months, 3x3 labels, 10 bins, 7x24 hours) is a fixed,
tiny axis table. The aggregate joined onto it is bounded by the same axes
because its keys are filtered to the grid's domain first, so broadcasting
it is safe at any data volume.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def grid(spark: SparkSession, **axes) -> DataFrame:
    """Cartesian axis table built on the driver from short literal lists."""
    names = list(axes)
    rows = list(itertools.product(*(axes[n] for n in names)))
    return spark.createDataFrame(rows, names)


def zero_fill(agg: DataFrame, axes: DataFrame, keys: list[str], counts: list[str]) -> DataFrame:
    """Right-join a bounded aggregate onto its axis grid; missing cells count 0."""
    joined = F.broadcast(agg).join(axes, keys, "right")
    return joined.fillna(0, subset=counts)


def checked_broadcast(df: DataFrame, max_rows: int) -> tuple[DataFrame, bool]:
    """Broadcast ``df`` only when it provably holds at most ``max_rows`` rows.

    Runs a bounded count (stops after max_rows + 1 rows). Beyond the bound
    the frame is returned unhinted, so the planner falls back to a shuffle join.
    """
    n = df.limit(max_rows + 1).count()
    if n <= max_rows:
        return F.broadcast(df), True
    return df, False
