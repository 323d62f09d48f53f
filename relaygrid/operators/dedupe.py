"""Repeats: exact first-seen and a bounded, approximate one."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relaygrid import vocabulary as V
from relaygrid.functions.messages import Message, flag, text
from relaygrid.functions.ordered import SPLIT, carry_forward, position_splits


def dedupe_applies(df: DataFrame) -> Column:
    """Expedited and cache-bypassing binaries never count as repeats."""
    exempt = flag(F.col("flags.bypass_cache")) | flag(F.col("flags.expedite"))
    return Message(df).is_binary & ~exempt


def _keyed() -> Column:
    return text(F.col("kafka_key")) != ""


def repeat_reason(applies: Column, is_first: Column) -> Column:
    return F.when(applies & ~_keyed(), V.DUPLICATE_NO_KEY).when(applies & ~is_first, V.DUPLICATE)


def first_seen(df: DataFrame, consumer: list[str], row_id: str = "seq", alive: Column | None = None) -> DataFrame:
    """Add ``dedupe_reason``: NULL for the first row per consumer and key.

    ``row_id`` orders the rows and is unique.  The first position per key is a
    partial aggregate (a hot key costs one row per map task) and comes back by
    ``row_id``, which spreads evenly, instead of ranking a whole key in a window.
    """
    applies = dedupe_applies(df) if alive is None else dedupe_applies(df) & alive
    firsts = (
        df.where(applies & _keyed())
        .groupBy(*consumer, "kafka_key").agg(F.min(row_id).alias(row_id))
        .select(row_id, F.lit(True).alias("_first"))
    )
    reason = repeat_reason(applies, F.col("_first").isNotNull())
    return df.join(firsts, row_id, "left").withColumn("dedupe_reason", reason).drop("_first")


def slot_count(size_bytes: int) -> int:
    """Entries of a bounded table: bytes rounded up to a power of two, 8 each."""
    rounded = 2 ** math.ceil(math.log2(size_bytes)) if size_bytes > 0 else 8
    return max(rounded, 8) // 8


def bounded_first_seen(
    df: DataFrame, size_bytes: int, hash_expr: Column | None = None,
    row_id: str = "seq", rows_per_split: int = 1 << 20,
) -> DataFrame:
    """Add ``is_repeat`` and ``is_collision`` of a direct-mapped hash table.

    A row is a repeat when the previous row of its slot had the same hash; the
    slot then holds the row's hash.  A zero hash looks seen in an empty slot.
    """
    hashed = F.xxhash64("kafka_key") if hash_expr is None else hash_expr
    slots = df.withColumn("_hash", hashed).withColumn("_slot", F.col("_hash").bitwiseAND(slot_count(size_bytes) - 1))
    cut = position_splits(slots, row_id, rows_per_split)
    held = carry_forward(cut, ["_slot"], [row_id], F.col("_hash"), "_held", include_current=False)
    before = F.coalesce("_held", F.lit(0))
    return (
        held.withColumn("is_repeat", before == F.col("_hash"))
        .withColumn("is_collision", (before != F.col("_hash")) & (before != 0))
        .drop("_hash", "_slot", "_held", SPLIT)
    )


def dedupe_stats(flagged: DataFrame) -> DataFrame:
    """Lookups, hits and collisions of :func:`bounded_first_seen`."""
    return flagged.agg(
        F.count("*").alias("lookups"),
        F.count_if("is_repeat").alias("hits"),
        F.count_if("is_collision").alias("collisions"),
    )
