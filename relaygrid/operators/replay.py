"""Answering a message from an earlier completed run on the same entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relaygrid import vocabulary as V
from relaygrid.functions.messages import Message, flag, from_end
from relaygrid.functions.ordered import carry_forward, range_splits
from relaygrid.operators.filters import instant
from relaygrid.operators.projections import inherited_flags, is_completed
from relaygrid.session import settle


def is_cacheable(min_runtime_s: float = V.REPLAY_MIN_RUNTIME_S, max_bytes: int | None = None, completed=V.STATUS_COMPLETED) -> Column:
    """Completed, ran long enough and small enough to keep."""
    keep = is_completed(F.col("status"), completed) & (F.col("status.runtime") > min_runtime_s)
    if max_bytes is not None:
        keep = keep & (F.octet_length(F.to_json("status")) <= max_bytes)
    return keep


def cacheable(statuses: DataFrame, min_runtime_s: float = V.REPLAY_MIN_RUNTIME_S,
              max_bytes: int | None = None, completed=V.STATUS_COMPLETED) -> DataFrame:
    """Completed statuses that ran long enough and are small enough to keep."""
    return statuses.where(is_cacheable(min_runtime_s, max_bytes, completed))


def of_consumer(statuses: DataFrame, name: str, version: str) -> DataFrame:
    """The cached statuses of one consumer."""
    return statuses.where((F.col("author.name") == name) & (F.col("author.version") == version))


def match_completions(
    events: DataFrame, statuses: DataFrame, consumer: tuple[Column, Column],
    ttl_s: float = V.REPLAY_TTL_S, row_id: str = "seq",
) -> DataFrame:
    """(row id, status id) of each event a cached status answers.

    As-of match: the newest status at or before the event, no older than the
    TTL, with the same entity, consumer name and version.  Only narrow probe
    rows are ordered; they are cut into even splits, so a hot entity spreads.
    """
    key = ["sha256", "consumer_name", "consumer_version"]
    probes = events.where(Message(events).is_binary & ~flag(F.col("flags.bypass_cache"))).select(
        F.col("entity.sha256").alias("sha256"), consumer[0].alias("consumer_name"),
        consumer[1].alias("consumer_version"), F.col("timestamp").alias("at"),
        F.lit(1).alias("side"), F.col(row_id).alias("id"),
    )
    cached = statuses.select(
        F.col("status.input.entity.sha256").alias("sha256"), F.col("author.name").alias("consumer_name"),
        F.col("author.version").alias("consumer_version"), F.col("timestamp").alias("at"),
        F.lit(0).alias("side"), F.col(row_id).alias("id"),
    )
    cached = settle(cached, "replay-cached")
    # events without a cached run of their entity are not ordered at all
    known = cached.select(*key).distinct()
    probes = probes.join(known, key, "left_semi")
    cut = range_splits(probes.unionByName(cached), key, ["at", "side", "id"], "replay")
    hit = F.when(F.col("side") == 0, F.struct("id", "at"))
    matched = carry_forward(cut, key, ["at", "side", "id"], hit, "hit", include_current=True)
    age = F.unix_micros("at") - F.unix_micros("hit.at")
    return matched.where((F.col("side") == 1) & (age < int(ttl_s * 1_000_000))).select(
        F.col("id").alias(row_id), F.col("hit.id").alias("status_id")
    )


def newest_completions(statuses: DataFrame, row_id: str = "seq") -> DataFrame:
    """What the cache holds: per entity, plugin and version the last status."""
    row = F.struct(*statuses.columns)
    key = [F.col("status.input.entity.sha256"), F.col("author.name"), F.col("author.version")]
    return statuses.groupBy(*[k.alias(f"_k{i}") for i, k in enumerate(key)]).agg(
        F.max_by(row, F.struct("timestamp", row_id)).alias("n")
    ).select("n.*")


def replay_completions(
    events: DataFrame, statuses: DataFrame, matches: DataFrame, now, row_id: str = "seq"
) -> tuple[DataFrame, DataFrame]:
    """(events with ``replay_reason``, results re-emitted for the answered ones).

    A match without results still answers its event.
    """
    flagged = (
        events.join(matches, row_id, "left")
        .withColumn("replay_reason", F.when(F.col("status_id").isNotNull(), V.CACHED))
        .drop("status_id")
    )
    cached = statuses.select(F.col(row_id).alias("status_id"), F.col("status").alias("_cached"))
    trigger = events.select(row_id, F.col("source").alias("_source"), F.col("flags").alias("_flags"))
    answered = matches.join(cached, "status_id").join(trigger, row_id)
    return flagged, replayed_results(answered, now, row_id)


def replayed_results(answered: DataFrame, now, row_id: str = "seq") -> DataFrame:
    """The results of cached statuses as results of the messages they answer.

    ``answered`` has the row id, ``status_id``, ``_source`` and ``_flags`` of
    the message, and ``_cached``, the status.
    """
    now = instant(now)
    last = from_end(F.col("_cached.input.source.path"), 0)
    path = F.when(
        last.isNotNull(), F.array_append(F.col("_source.path"), last.withField("timestamp", now))
    ).otherwise(F.col("_source.path"))
    result = (
        F.col("r").withField("flags", inherited_flags(F.col("_flags"), replayed=True))
        .withField("source", F.col("_source").withField("path", path))
        .withField("timestamp", now)
    )
    return (
        answered.select(row_id, "status_id", "_source", "_flags", "_cached", F.posexplode("_cached.results").alias("result_no", "r"))
        .select(row_id, "status_id", "result_no", result.alias("r"))
        .select(row_id, "status_id", "result_no", F.lit("binary").alias("model"), "r.*")
    )


def artifact_copies(matches: DataFrame, events: DataFrame, statuses: DataFrame, row_id: str = "seq") -> DataFrame:
    """Blob copies a replay needs: result streams from the cached source to the
    event's source, where the two differ."""
    cached = statuses.select(
        F.col(row_id).alias("status_id"), F.col("status.input.source.name").alias("source_from"),
        F.explode("status.results").alias("r"),
    ).select("status_id", "source_from", F.explode("r.entity.datastreams").alias("d"))
    target = events.select(row_id, F.col("source.name").alias("source_to"))
    return (
        matches.join(cached, "status_id").join(target, row_id)
        .where(F.col("source_from") != F.col("source_to"))
        .select("source_from", "source_to", F.col("d.label").alias("label"), F.col("d.sha256").alias("sha256"))
        .distinct()
    )


def replay_stats(matches: DataFrame, statuses: DataFrame, row_id: str = "seq") -> DataFrame:
    """Hits and processing seconds saved, by plugin."""
    runtime = statuses.select(
        F.col(row_id).alias("status_id"), F.col("author.name").alias("plugin"), F.col("status.runtime").alias("runtime")
    )
    # one row per status before the join: a hot status answers many events
    hits = matches.groupBy("status_id").agg(F.count("*").alias("n"))
    return hits.join(runtime, "status_id").groupBy("plugin").agg(
        F.sum("n").alias("hits"), F.sum(F.col("n") * F.col("runtime")).alias("seconds_saved")
    )


def settle_matches(matches: DataFrame) -> DataFrame:
    return settle(matches, "replay-matches")

