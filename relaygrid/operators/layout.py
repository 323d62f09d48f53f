"""Stored layouts: a log in segments that progress prunes, and messages placed by key.

A *segment* holds the rows of one topic and partition within one band of
offsets, or within adjacent bands while these hold few rows.  Its name, unique over the whole log, is a
partition column, and a narrow table of segments keeps the offsets each covers.  Readers choose segments there first; the join with the
log then opens the chosen folders only (dynamic partition pruning).

A *placed* table is bucketed by key, so grouping, ranking or looking up by that
key moves no row of it.  Keys that would outgrow a bucket are stored beside it.
"""

from __future__ import annotations

from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from relaygrid import schemas
from relaygrid.functions.messages import Message
from relaygrid.operators import dedupe, oplog, purge
from relaygrid.session import settle, work_path

#: Offsets of a band.
BAND = 1_000_000
#: Bands join one segment until it holds so many rows: files grow in number with the rows, not with the offsets.
FILL = 250_000
SEGMENT = "segment"
COLUMNS = schemas.TOPIC_LOG.fieldNames()
_STORED = StructType([*schemas.TOPIC_LOG.fields, StructField(SEGMENT, StringType())])


@dataclass(frozen=True)
class StoredLog:
    """``rows``: the log with its segment; ``segments``: topic, partition, segment, first and last offset, rows."""

    rows: DataFrame
    segments: DataFrame

    def only(self, judged: DataFrame, open_: Column) -> DataFrame:
        """Log rows of the segments in ``judged`` for which ``open_`` holds.

        ``judged`` is settled with what decides, so the choice stays a
        comparison on a table of known size; that is what Spark prunes by.
        """
        chosen = settle(judged, "segments").where(open_).select(SEGMENT)
        return self.rows.join(chosen, SEGMENT, "left_semi").select(*COLUMNS)


def _runs(bands: DataFrame, fill: int) -> DataFrame:
    """The band each band's segment begins with; ``bands`` has topic, partition, band and n, its rows."""
    before = Window.partitionBy(*oplog.PARTITION).orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    run = F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / fill)
    # rows without an offset are no part of a run
    numbered = bands.where(F.col("band").isNotNull()).withColumn("run", run)
    return numbered.withColumn("begins", F.min("band").over(Window.partitionBy(*oplog.PARTITION, "run"))).select(*oplog.PARTITION, "band", "begins")


def append_log(log: DataFrame, path: str, band: int = BAND, fill: int = FILL) -> None:
    """Add rows to the log at ``path`` (created if missing), then their segments.

    A segment meets one task, which sorts it by offset: less than ``fill`` rows
    and one more band, which is at most ``band`` rows of one topic and partition,
    however hot the topic.  Rows count as stored once their segments are: what a
    failed append left behind is in no segment, and its rows come again under
    the name of another append.  ``log`` is read twice, at first for the number
    of rows of each band.
    """
    spark, append = log.sparkSession, uuid4().hex
    rows = log.select(*COLUMNS).withColumn("band", F.floor(F.col("offset") / band))
    runs = settle(_runs(rows.groupBy(*oplog.PARTITION, "band").agg(F.count(F.lit(1)).alias("n")), fill), "segment-runs")
    named = [F.col(c).alias(f"_{c}") for c in (*oplog.PARTITION, "band")]
    same = F.col("band") == F.col("_band")
    for c in oplog.PARTITION:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    # a band that was not counted is a segment of its own
    name = F.concat_ws("~", "topic", "partition", F.coalesce("begins", "band"), F.lit(append))
    met = rows.join(runs.select(*named, "begins"), same, "left").withColumn(SEGMENT, name).select(*COLUMNS, SEGMENT)
    folder = f"{path}/rows/append={append}"
    met.repartition(SEGMENT).sortWithinPartitions("topic", SEGMENT, "offset").write.partitionBy("topic", SEGMENT).parquet(folder)
    # from the files just written, offsets only
    held = spark.read.schema(_STORED).parquet(folder).groupBy("topic", "partition", SEGMENT).agg(
        F.min("offset").alias("first"), F.max("offset").alias("last"), F.count(F.lit(1)).alias("n"),
    )
    held.coalesce(1).write.mode("append").parquet(f"{path}/segments")


def stored_log(spark: SparkSession, path: str) -> StoredLog:
    return StoredLog(spark.read.schema(_STORED).parquet(f"{path}/rows").drop("append"), spark.read.parquet(f"{path}/segments"))


def resume_stored(log: StoredLog, offsets: DataFrame, start: str, group: str) -> DataFrame:
    """:func:`relaygrid.operators.oplog.resume_scan` over a stored log.

    Same rows; the folders of segments that the group has read are not opened,
    and a group that is caught up opens none.
    """
    mine = offsets.where(F.col("consumer_group") == group).select(*oplog.PARTITION, "committed")
    known = log.segments.join(mine, oplog.PARTITION, "left")
    behind = F.coalesce("committed", F.lit(0)) if start == "earliest" else F.col("committed")
    unread = log.only(known.select(SEGMENT, "last", behind.alias("committed")), F.col("last") >= F.col("committed"))
    return oplog.resume_scan(unread, offsets, start, group)


def stored_watermarks(log: StoredLog) -> DataFrame:
    """End of each partition, from the segments alone."""
    return log.segments.groupBy(*oplog.PARTITION).agg((F.max("last") + 1).alias("high_watermark"))


@dataclass(frozen=True)
class Placed:
    """``even``: bucketed by ``key``; ``hot``: the rows of keys that hold more than a bucket's even share."""

    even: DataFrame
    hot: DataFrame
    key: str
    tables: tuple[str, ...]

    def drop(self) -> None:
        """Forget the table; its files stay until the work folder goes."""
        for name in self.tables:
            self.even.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")


def place_by_key(df: DataFrame, key: str, buckets: int, name: str = "placed") -> Placed:
    """Write ``df`` so that equal keys share a bucket, which later work by that key relies on.

    Keys with more than 1/``buckets`` of all rows, of which there are fewer than
    ``buckets``, are kept apart and spread evenly, so no bucket grows beyond
    about twice its share by one key.  NULL is a key like others.  ``df`` is read
    three times, at first for its keys alone, so it had better be stored.
    """
    spark = df.sparkSession
    counts = settle(df.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("n")), f"{name}-keys")
    total = counts.agg(F.sum("n")).first()[0] or 0
    heavy = settle(counts.where(F.col("n") * buckets > total).select("_key"), f"{name}-heavy")
    same = F.col(key).eqNullSafe(F.col("_key"))
    table, path = f"{name}_{uuid4().hex}", work_path(spark, name)
    # a task writes whole buckets: the same hash deals rows to tasks and to buckets
    even = df.join(heavy, same, "left_anti").repartition(buckets, key)
    even.write.bucketBy(buckets, key).sortBy(key).format("parquet").option("path", path).saveAsTable(table)
    hot = settle(df.join(heavy, same, "left_semi"), f"{name}-hot")
    return Placed(spark.table(table), hot, key, (table,))


def placed_compacted(log: Placed) -> DataFrame:
    """:func:`relaygrid.operators.oplog.compacted_view` of a log placed by its key, without moving it."""
    newest = F.max(F.struct("offset", "partition")).over(Window.partitionBy("topic", log.key))
    last = log.even.withColumn("_last", newest).where((F.struct("offset", "partition") == F.col("_last")) & F.col("value").isNotNull())
    columns = ["topic", "key", "partition", "offset", "value", "ts"]
    return last.select(*columns).unionByName(oplog.compacted_view(log.hot).select(*columns))


def placed_first_seen(messages: Placed, consumer: list[str], row_id: str = "seq") -> DataFrame:
    """:func:`relaygrid.operators.dedupe.first_seen` of messages placed by ``kafka_key``, without moving them."""
    applies = dedupe.dedupe_applies(messages.even)
    first = F.min(F.when(applies, F.col(row_id))).over(Window.partitionBy(*consumer, messages.key))
    even = messages.even.withColumn("_first", first)
    reason = dedupe.repeat_reason(applies, F.col("_first") == F.col(row_id))
    return even.withColumn("dedupe_reason", reason).drop("_first").unionByName(dedupe.first_seen(messages.hot, consumer, row_id))


def placed_purge_by_id(messages: Placed, register: DataFrame) -> DataFrame:
    """:func:`relaygrid.operators.purge.purge_by_id` of messages placed by ``kafka_key``.

    The register's ids go to where the messages are; a register too large to be
    broadcast is the only side that moves.
    """
    ids = register.where(F.col("kind") == purge.BY_ID).select(F.col("token").alias("_token")).distinct()

    def kept(df: DataFrame) -> DataFrame:
        return df.join(ids, (df[messages.key] == F.col("_token")) & Message(df).is_binary, "left_anti")

    return kept(messages.even).unionByName(kept(messages.hot))
