"""The message log: compaction, progress, paging, lag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relaygrid import vocabulary as V
from relaygrid.functions.routing import DEFAULT_NAMING, Naming, binary_topic_pattern, check_actions
from relaygrid.session import settle

PARTITION = ["topic", "partition"]


def scan_topics(log: DataFrame, sources=None, actions=None, naming: Naming = DEFAULT_NAMING) -> DataFrame:
    """Rows of the binary topics of some sources and actions.

    Named sources and actions become an ``IN`` on the topic, which prunes
    partitions of a log stored by topic; open sides fall back to the pattern.
    """
    pattern = binary_topic_pattern(sources, actions, naming)
    if sources and actions:
        names = [f"{naming.prefix}.{s}.binary.{a}" for s in sources for a in check_actions(actions)]
        return log.where(F.col("topic").isin(names))
    return log.where(F.col("topic").rlike(pattern))


def watermarks(log: DataFrame) -> DataFrame:
    """End of each partition: the offset the next message will get."""
    return log.groupBy(*PARTITION).agg((F.max("offset") + 1).alias("high_watermark"))


def resume_scan(log: DataFrame, offsets: DataFrame, start: str, group: str) -> DataFrame:
    """Rows a consumer group has not read: from its committed offset, else from
    ``earliest`` (all rows) or ``latest`` (none of the present rows)."""
    if start not in ("earliest", "latest"):
        raise ValueError(f"unknown start offset: {start}")
    mine = offsets.where(F.col("consumer_group") == group).select(*PARTITION, "committed")
    joined = log.join(mine, PARTITION, "left")
    if start == "earliest":
        return joined.where(F.col("offset") >= F.coalesce("committed", F.lit(0))).drop("committed")
    return joined.where(F.col("offset") >= F.col("committed")).drop("committed")


def latest_positions(log: DataFrame, key: list[str]) -> DataFrame:
    """Per key the place of its last row (by offset, then partition): keys and positions only.

    The position is one number, so this is a hash aggregate with partial
    results on the map side; a hot key sends one row per map task.
    """
    place = F.col("offset").cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(10,0)") + F.col("partition").cast("decimal(10,0)")
    newest = log.groupBy(*key).agg(F.max(place.cast("decimal(38,0)")).alias("_place"))
    width = F.lit(1 << 31).cast("decimal(10,0)")
    offset = F.floor(F.col("_place") / width).cast("bigint")
    return newest.select(*key, (F.col("_place") % width).cast("int").alias("partition"), offset.alias("offset"))


def compacted_view(log: DataFrame) -> DataFrame:
    """Last value per (topic, key); a NULL value deletes the key.

    Values take no part in finding the last rows; those found come out of the
    log by their position.
    """
    newest = settle(latest_positions(log, ["topic", "key"]).select("topic", "partition", "offset"), "last-positions")
    rows = log.where(F.col("value").isNotNull()).join(newest, ["topic", "partition", "offset"], "left_semi")
    return rows.select("topic", "key", "partition", "offset", "value", "ts")


def compact_onto(base: DataFrame, added: DataFrame) -> DataFrame:
    """The compacted view of a log from that of its older part and the rows added since.

    The added rows are compacted by themselves; keys they name leave the base,
    whose values are neither compared nor ordered again.  Offsets of added rows
    are higher than those of the base.
    """
    named = added.select("topic", F.col("key").alias("_key")).distinct()
    same = (base["topic"] == named["topic"]) & base["key"].eqNullSafe(named["_key"])
    return base.join(named, same, "left_anti").unionByName(compacted_view(added))


def lag_report(log: DataFrame, offsets: DataFrame) -> DataFrame:
    """Per group and partition: next offset, end, lag and whether caught up."""
    ends = watermarks(log)
    return (
        offsets.join(ends, PARTITION, "left")
        .withColumn("high_watermark", F.coalesce("high_watermark", F.lit(0)))
        .withColumn("lag", F.greatest(F.col("high_watermark") - F.col("committed"), F.lit(0)))
        .withColumn(
            "caught_up",
            (F.col("high_watermark") == 0) | (F.col("committed") >= F.col("high_watermark") - 1),
        )
    )


def groups_caught_up(report: DataFrame) -> DataFrame:
    return report.groupBy("consumer_group").agg(
        F.bool_and("caught_up").alias("caught_up"), F.sum("lag").alias("lag")
    )


def pull_count(count: int) -> int:
    """How many messages one fetch may hand out."""
    return V.FETCH_DEFAULT if count <= 0 else min(count, V.FETCH_LIMIT)


def priority_pull(deliveries: DataFrame, count: int, order: list[str] | None = None) -> DataFrame:
    """The next ``count`` survivors: expedite first, then live, then historic.

    Top-k per task, then a merge of the small rests; never a full sort.
    """
    return deliveries.orderBy(*(order or ["priority", "ts", "topic", "partition", "offset"])).limit(pull_count(count))


def priority_pull_each(deliveries: DataFrame, consumer: list[str], limit: Column, order: list[str]) -> DataFrame:
    """The same for many consumers at once; ``limit`` is each one's count.

    The constant ceiling lets Spark cut each key to the fetch limit on the map
    side before ranking, so a hot consumer does not fill one task.
    """
    rank = F.row_number().over(Window.partitionBy(*consumer).orderBy(*order))
    ceiling = deliveries.withColumn("rank", rank).where(F.col("rank") <= V.FETCH_LIMIT)
    wanted = F.when(limit <= 0, V.FETCH_DEFAULT).otherwise(F.least(limit, F.lit(V.FETCH_LIMIT)))
    return ceiling.where(F.col("rank") <= wanted)


def page(log: DataFrame, offsets: DataFrame, group: str, count: int) -> tuple[DataFrame, DataFrame]:
    """(next ``count`` rows, offsets after reading them); call again to go on."""
    order = ["ts", *PARTITION, "offset"]
    rows = resume_scan(log, offsets, "earliest", group).orderBy(*order).limit(count)
    read = rows.groupBy(*PARTITION).agg((F.max("offset") + 1).alias("committed"))
    moved = read.select(F.lit(group).alias("consumer_group"), *PARTITION, "committed")
    both = offsets.unionByName(moved)
    return rows, both.groupBy("consumer_group", *PARTITION).agg(F.max("committed").alias("committed"))


def colocate_by_key(df: DataFrame, partitions: int, key: str = "kafka_key") -> DataFrame:
    """Same key, same partition.

    This is the layout the log promises; a hot key stays together by contract,
    so operators never rely on it for balance.
    """
    return df.repartition(partitions, key)


def live_plus_historic(live: DataFrame, historic: DataFrame) -> DataFrame:
    """Both feeds deliver the same message unless a dedupe follows.

    ``delivery`` numbers the copies uniquely for that dedupe: the live copy of
    position n is 2n, the historic one 2n + 1.
    """
    first = live.withColumn("feed", F.lit("live")).withColumn("delivery", F.col("seq") * 2)
    second = historic.withColumn("feed", F.lit("historic")).withColumn("delivery", F.col("seq") * 2 + 1)
    return first.unionByName(second)
