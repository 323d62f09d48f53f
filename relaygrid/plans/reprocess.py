"""Reprocessing: an old namespace decoded, re-keyed and re-routed to a new one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relaygrid.functions.identity import identity_key
from relaygrid.functions.routing import Naming, model_of_topic, topic_expr
from relaygrid.operators.filters import drop_tombstones
from relaygrid.plans.decode import decode_messages
from relaygrid.plans.publish import encode

SOURCES_PROFILE, SYSTEM_PROFILE = "sources", "system"


def topic_selection(
    old: Naming, upgrade_sources: bool = False, upgrade_system: bool = False, include_system=(), deny=(),
) -> tuple[str, Column]:
    """(profile, condition on ``topic``); exactly one profile must be chosen.

    The patterns are open at the end on purpose: a source topic may have any
    suffix, and a system name selects every topic it is a prefix of.
    """
    if upgrade_sources and upgrade_system:
        raise ValueError("cannot reprocess sources and system topics at the same time")
    if not (upgrade_sources or upgrade_system):
        raise ValueError("no profile chosen for reprocessing")
    head = rf"^{old.root}\.{old.namespace}\."
    if upgrade_sources:
        profile, pattern = SOURCES_PROFILE, head + r"[^\.]+\.binary.*"
    else:
        profile, pattern = SYSTEM_PROFILE, head + rf"system\.({'|'.join(include_system)})"
    chosen = F.col("topic").rlike(pattern)
    if deny:
        chosen = chosen & ~F.col("topic").isin(*deny)
    return profile, chosen


def reprocess(
    log: DataFrame, old: Naming, new: Naming, upgrade_sources: bool = False, upgrade_system: bool = False,
    include_system=(), deny=(),
) -> DataFrame:
    """Rows ``topic, key, value`` for the new namespace, with ``source_topic``.

    Only the key changes, in the row and inside its value; nothing else of the
    plan for fresh messages runs.  Values that do not decode are left behind.
    Works on batch and streaming logs.
    """
    profile, chosen = topic_selection(old, upgrade_sources, upgrade_system, include_system, deny)
    rows = drop_tombstones(log.where(chosen))
    if not log.isStreaming and rows.isEmpty():
        raise ValueError("no topics found to reprocess")
    model = model_of_topic(F.col("topic"), profile == SYSTEM_PROFILE)
    messages = decode_messages(rows, model).withColumnRenamed("topic", "source_topic")
    place = F.concat_ws("/", "source_topic", F.col("partition").cast("string"), F.col("offset").cast("string"))
    keyed = identity_key(messages, seed=place)
    # models without a schema here keep their text
    value = F.coalesce(encode(keyed), F.col("value"))
    return keyed.select(
        "source_topic", "partition", "offset", topic_expr(keyed, new).alias("topic"),
        F.col("kafka_key").alias("key"), value.alias("value"), "ts",
    )
