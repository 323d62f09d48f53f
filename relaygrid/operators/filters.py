"""Filters.  Each yields the reason a row is dropped for, or NULL to keep it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relaygrid import vocabulary as V
from relaygrid.functions.messages import Message, array_length, depth, flag, text


def instant(value) -> Column:
    """``now`` as an explicit argument: a Column, a datetime or text."""
    return value if isinstance(value, Column) else F.lit(value).cast("timestamp")


def too_deep(df: DataFrame, max_depth: int) -> Column:
    deep = depth(F.col("source.path")) > max_depth
    return F.when(Message(df).is_binary & deep, V.TOO_DEEP)


def with_expiry(df: DataFrame, sources: DataFrame) -> DataFrame:
    """Attach ``expire_ms`` of the message's source; NULL for unknown sources."""
    msg = Message(df)
    known = sources.where(F.col("expire_ms") > 0).select(
        F.col("source_name").alias("_source"), F.col("expire_ms")
    )
    name = F.when(msg.has_subject, msg.subject("source.name"))
    return df.withColumn("_source", name).join(known, "_source", "left").drop("_source")


def ageoff(df: DataFrame, now) -> Column:
    """Expects ``expire_ms`` (see :func:`with_expiry`); NULL never expires."""
    msg = Message(df)
    ends = F.unix_micros(msg.subject("source.timestamp")) + F.col("expire_ms") * 1000
    return F.when(msg.has_subject & (ends < F.unix_micros(instant(now))), V.AGEOFF)


def self_filter(df: DataFrame, name: Column | str) -> Column:
    name = name if isinstance(name, Column) else F.lit(name)
    return F.when(Message(df).is_binary & (F.col("author.name") == name), V.SELF_IGNORED)


def flag_filter(df: DataFrame, which: str = "expedite") -> Column:
    return F.when(flag(F.col(f"flags.{which}")), V.FLAGGED)


def drop_tombstones(log: DataFrame) -> DataFrame:
    """Rows without a value are skipped silently, not counted as filtered."""
    return log.where(F.octet_length(F.col("value")) > 0)


def drop_undecodable(log: DataFrame, schema) -> DataFrame:
    """Decode JSON values into ``event``; undecodable rows are skipped."""
    probe = "_broken"
    decoded = F.from_json(
        "value", _with_corrupt(schema, probe),
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": probe},
    )
    return (
        log.withColumn("event", decoded)
        .where(F.col("event").isNotNull() & F.col(f"event.{probe}").isNull())
        .withColumn("event", F.col("event").dropFields(probe))
    )


def _with_corrupt(schema: T.StructType, probe: str) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(probe, T.StringType())])


def retention(log: DataFrame, policy: DataFrame, now) -> DataFrame:
    """Drop rows of delete-policy topics that are older than their retention."""
    rules = policy.where(F.col("cleanup") == "delete").select("topic", "retention_ms")
    age_ms = (F.unix_micros(instant(now)) - F.unix_micros("ts")) / 1000
    expired = (F.col("retention_ms") >= 0) & (age_ms > F.col("retention_ms"))
    return log.join(rules, "topic", "left").where(~flag(expired)).drop("retention_ms")


def consumer_rules(df: DataFrame, spec: Column) -> Column:
    """Ordered routing rules of one consumer; the first violated rule wins.

    ``spec`` is a consumer struct: a literal (then unused rules fold away at
    planning time) or a column (then one plan serves many consumers).
    """
    msg = Message(df)
    source = text(msg.subject("source.name"))
    action = text(msg.subject("action"))
    author = text(msg.subject("author.name"))
    routing = (
        F.when((F.size(spec["require_sources"]) > 0) & ~F.array_contains(spec["require_sources"], source), V.REJECT_SOURCE)
        .when((F.size(spec["require_events"]) > 0) & ~F.array_contains(spec["require_events"], action), V.REJECT_EVENT_TYPE)
        .when((F.size(spec["deny_events"]) > 0) & F.array_contains(spec["deny_events"], action), V.REJECT_EVENT_TYPE)
        .when(flag(spec["deny_self"]) & (author == text(spec["name"])), V.REJECT_SELF)
    )
    by_content = _content_rules(F.col("entity.datastreams"), spec) if msg.has("entity") else F.lit(None)
    return F.when(msg.has_subject, F.coalesce(routing, F.when(msg.is_binary, by_content)))


def _content_rules(streams: Column, spec: Column) -> Column:
    """Rules on the streams of a binary, in stream order, then on all of them."""
    wanted = spec["require_streams"]
    under, over = spec["require_under_content_size"], spec["require_over_content_size"]
    has_wanted = F.size(wanted) > 0

    def stream_reason(stream: Column) -> Column:
        is_content = stream["label"] == V.CONTENT_LABEL
        listed = F.map_contains_key(wanted, stream["label"])
        prefixes = F.when(listed, F.element_at(wanted, stream["label"])).otherwise(
            F.element_at(wanted, F.lit("*"))
        )
        fits = F.exists(prefixes, lambda p: text(stream["file_format"]).startswith(p))
        return (
            F.when(is_content & (under > 0) & (stream["size"] > under), V.REJECT_TOO_LARGE)
            .when(is_content & (over > 0) & (stream["size"] < over), V.REJECT_TOO_SMALL)
            .when(has_wanted & prefixes.isNull(), V.REJECT_STREAM)
            .when(has_wanted & (F.size(prefixes) > 0) & ~fits, V.REJECT_FILE_FORMAT)
        )

    reasons = F.filter(F.transform(streams, stream_reason), lambda r: r.isNotNull())
    checks_streams = has_wanted | (under > 0) | (over > 0)
    first_stream_reason = F.when(checks_streams, F.get(reasons, F.lit(0)))
    # every stream left unrejected counts as a match, whatever its label
    too_few = (F.size(wanted) > 1) & (array_length(streams) < F.size(wanted))
    has_content = flag(F.exists(streams, lambda s: s["label"] == V.CONTENT_LABEL))
    needs_content = flag(spec["require_content"]) | (under > 0) | (over > 0)

    overall = F.when(too_few, V.REJECT_STREAM).when(needs_content & ~has_content, V.REJECT_NO_CONTENT)
    return F.coalesce(first_stream_reason, overall)
