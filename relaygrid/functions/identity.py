"""Stable identity of messages and consumers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relaygrid.functions.messages import Message, depth, from_end, text


def dotted_entries(entries: Column) -> Column:
    """Map entries as ``key.value.`` pieces in byte order, glued together."""
    pairs = F.transform(F.map_entries(entries), lambda e: F.concat(e["key"], F.lit("."), text(e["value"])))
    return _glue(F.sort_array(pairs))


def distinct_sorted(values: Column) -> Column:
    """Distinct non-empty strings in byte order."""
    return F.sort_array(F.array_distinct(F.filter(values, lambda v: v.isNotNull() & (v != ""))))


def _glue(parts: Column) -> Column:
    """Each element followed by a dot; empty string for a NULL array."""
    return F.when(F.size(parts) > 0, F.concat(F.array_join(parts, "."), F.lit("."))).otherwise(F.lit(""))


def wall_clock(timestamp: Column) -> Column:
    """First 19 characters of the RFC 3339 form, from a timestamp or its raw text.

    The identity uses the clock reading of the timestamp's own offset.  A typed
    timestamp has lost that offset, so sources in other zones pass raw text.
    """
    return F.substring(F.regexp_replace(timestamp.cast("string"), " ", "T"), 1, 19)


#: Column that holds the submission time as it was written, offset and all, beside the typed instant.
CLOCK = "source_clock"


def written_clock(df: DataFrame) -> Column | None:
    """The clock reading to key by: of the written time where the frame has it, else of the instant."""
    return wall_clock(F.coalesce(CLOCK, F.col("source.timestamp").cast("string"))) if CLOCK in df.columns else None


# fixed value: how a message without a submission time reads
_NO_TIME = "0001-01-01T00:00:00"


def _node(path: Column, back: int) -> Column:
    """Author, action and hash of one lineage node; empty when there is none."""
    piece = F.concat(*[
        F.concat(text(from_end(leaf, back)), F.lit("."))
        for leaf in (path["author"]["name"], path["action"], path["sha256"])
    ])
    return F.when(depth(path) > back, piece).otherwise(F.lit(""))


def binary_descriptor(source: Column, clock: Column | None = None) -> Column:
    """What makes a binary message unique; NULL when it has no lineage.

    Source, submission time, references, settings, every security on the
    lineage, then the parent and the current lineage node.  Author versions and
    earlier ancestors are left out, so such repeats share one identity.  Only
    leaves of the lineage are touched, so a scan reads nothing else of it.
    """
    path = source["path"]
    clock = F.coalesce(wall_clock(source["timestamp"]) if clock is None else clock, F.lit(_NO_TIME))
    securities = distinct_sorted(path["author"]["security"])
    descriptor = F.concat(
        text(source["name"]), F.lit("."), text(source["security"]), F.lit("."),
        clock, F.lit("."),
        dotted_entries(source["references"]), dotted_entries(source["settings"]),
        _glue(securities), _node(path, 1), _node(path, 0),
    )
    return F.when(depth(path) > 0, descriptor)


def identity_expr(df: DataFrame, clock: Column | None = None, seed: Column | None = None) -> Column:
    """md5 identity of any message; NULL marks a binary that must be dropped.

    Models without a natural identity get one from ``seed``, any text unique to
    the message; without a seed it is random: store the result before using it
    twice, for a random identity changes on recomputation.
    """
    msg = Message(df)
    clock = written_clock(df) if clock is None and msg.has("source") else clock
    descriptor = binary_descriptor(F.col("source"), clock) if msg.has("source") else F.lit(None).cast("string")
    rule = F.when(msg.is_binary, F.md5(descriptor))
    if msg.has("status"):
        status = F.concat_ws(".", text(F.col("status.input.dequeued")), text(F.col("author.name")))
        rule = rule.when(msg.model == "status", F.md5(status))
    if msg.has("plugin"):
        plugin = F.concat_ws(".", text(F.col("plugin.name")), text(F.col("plugin.version")))
        rule = rule.when(msg.model == "plugin", F.md5(plugin))
    if msg.has("insert"):
        insert = F.concat_ws(
            ".", text(F.col("insert.parent_sha256")), text(F.col("insert.child.sha256")),
            text(F.col("insert.child_history.author.name")),
        )
        rule = rule.when(msg.model == "insert", F.md5(insert))
    return rule.otherwise(F.md5(F.uuid() if seed is None else seed))


def identity_key(df: DataFrame, clock: Column | None = None, seed: Column | None = None) -> DataFrame:
    """Set ``kafka_key``; binaries without lineage are dropped."""
    return df.where(has_identity(df)).withColumn("kafka_key", identity_expr(df, clock, seed))


def has_identity(df: DataFrame) -> Column:
    """The cheap test for what :func:`identity_expr` cannot key."""
    msg = Message(df)
    return ~msg.is_binary | (depth(F.col("source.path")) > 0) if msg.has("source") else ~msg.is_binary


def consumer_prefix(spec: Column) -> Column:
    return F.concat_ws("-", text(spec["name"]), text(spec["version"]), text(spec["model"]))


def consumer_key(spec: Column) -> Column:
    """Name of the progress group a consumer shares with its equals."""
    binary = spec["model"] == "binary"

    def part(values: Column, empty: str) -> Column:
        return F.when(F.size(values) > 0, F.array_join(values, ".")).otherwise(F.lit(empty))

    flow = F.concat(
        F.when(binary & spec["require_expedite"], "E").otherwise(""),
        F.when(spec["require_live"], "L").otherwise(""),
        F.when(spec["require_historic"], "H").otherwise(""),
        F.when(spec["debug"], "D").otherwise(""),
    )
    # concat_ws skips NULL parts
    return F.concat_ws(
        "-", consumer_prefix(spec),
        F.when(binary, part(spec["require_sources"], "allsrc")),
        F.when(binary, part(spec["require_events"], "alltype")),
        F.when(flow != "", flow),
    )
