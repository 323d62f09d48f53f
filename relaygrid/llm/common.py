"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: White space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def carried(docs: DataFrame) -> Column:
    """The whole row as one column, so that no name of it can clash with an operator's own."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def utf8(column: pa.Array) -> list[bytes]:
    """Texts of an Arrow column as UTF-8 bytes, null as empty.

    ``bytes.split()`` and ``bytes.lower()`` know exactly the six blanks and the
    letters A-Z of the contracts, and no byte of a longer sequence is either.
    """
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def buckets_for(df: DataFrame, rows: int = 20_000, least: int = 64) -> int:
    """Buckets that keep the bucket of an even hash near ``rows`` rows."""
    return max(least, -(-df.count() // rows))


def running(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, out: str, buckets: int) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows before, within ``group``.

    Rows of a group are ordered by (hash bucket of ``order``, ``order``).  The
    sums of buckets are pre-aggregated and accumulated over at most ``buckets``
    rows a group, so even a group that holds a third of all rows is dealt out
    over many tasks.  Rows equal in ``order`` stand in any order; nulls form
    one group.
    """
    keys = ["__group", "__bucket"]
    keyed = df.withColumns({
        "__group": F.struct(F.lit(0).alias("all"), *group),
        "__bucket": F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"),
    })
    before = Window.partitionBy("__group").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = (
        keyed.groupBy(*keys).agg(F.sum(value).alias("__sum"))
        .select(*keys, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__base"))
    )
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        keyed.join(base, keys)
        .withColumn(out, F.col("__base") + F.coalesce(F.sum(value).over(within), F.lit(0)))
        .drop(*keys, "__base")
    )
