"""Ordered carry-forward that no hot key can overload.

A window over a key puts all rows of that key into one task.  Here rows are
first cut into *splits*, contiguous pieces of the (key, order) sequence; the
window runs inside (split, key), and one summary row per (split, key) carries
the state across split borders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relaygrid.session import settle

SPLIT = "_split"


def range_splits(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Cut by sampled ranges of (keys, order): even pieces for any key skew.

    ``order`` must end in a unique column so that even equal keys and times can
    be cut.  The result is settled, because the sampled borders must not move
    when the two branches of :func:`carry_forward` read it.
    """
    ranged = df.repartitionByRange(*keys, *order)
    return settle(ranged.withColumn(SPLIT, F.spark_partition_id().cast("bigint")), name)


def position_splits(df: DataFrame, position: str, rows_per_split: int) -> DataFrame:
    """Cut by log position; a split holds at most ``rows_per_split`` rows."""
    return df.withColumn(SPLIT, F.floor(F.col(position) / F.lit(rows_per_split)).cast("bigint"))


def carry_forward(
    df: DataFrame, keys: list[str], order: list[str], value: Column, out: str, include_current: bool
) -> DataFrame:
    """Add ``out``: the latest non-NULL ``value`` of the same key up to each row."""
    df = df.withColumn("_value", value)
    group = [SPLIT, *keys]
    seen = F.when(F.col("_value").isNotNull(), F.struct(*order, F.col("_value").alias("v")))
    tails = df.groupBy(*group).agg(F.max(seen).alias("_tail"))
    # one row per split and key: even without keys no more rows than splits
    across = Window.partitionBy(*keys).orderBy(SPLIT).rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        tails.withColumn("_carried", F.last("_tail", ignorenulls=True).over(across)["v"])
        .where(F.col("_carried").isNotNull())
        .drop("_tail")
    )
    last_row = Window.currentRow if include_current else -1
    within = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, last_row)
    return (
        df.withColumn("_own", F.last("_value", ignorenulls=True).over(within))
        .join(carried, group, "left")
        .withColumn(out, F.coalesce("_own", "_carried"))
        .drop("_value", "_own", "_carried")
    )
