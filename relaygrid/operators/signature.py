"""Signatures: what routing rules see of an event, equal for events that no rule tells apart.

Content sizes count only by where they lie between the bounds that some rule
names, so there are far fewer signatures than events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relaygrid import vocabulary as V
from relaygrid.functions.messages import Message, flag
from relaygrid.operators import filters


def bounds(kinds: DataFrame) -> list[int]:
    """The content sizes some spec compares with; as many as specs name."""
    return sorted(r["b"] for r in _named(kinds).collect())


def few_bounds(kinds: DataFrame, most: int) -> list[int] | None:
    """:func:`bounds`, or None where there are more than ``most``."""
    found = sorted(r["b"] for r in _named(kinds).limit(most + 1).collect())
    return found if len(found) <= most else None


def _named(kinds: DataFrame) -> DataFrame:
    named = kinds.select(F.explode(F.array("spec.require_under_content_size", "spec.require_over_content_size")).alias("b"))
    return named.where("b > 0").distinct()


def _place(size: Column, limits: list[int] | None) -> Column:
    """A size that compares with all limits as ``size`` does, one per gap between them; without limits the size itself."""
    if limits is None:
        return size
    if not limits:
        return F.when(size.isNotNull(), F.lit(0).cast("long"))
    below = F.array_max(F.filter(F.array(*[F.lit(b).cast("long") for b in limits]), lambda b: b <= size))
    return F.when(size.isNull(), None).when(below.isNull(), F.lit(limits[0] - 1)).when(below == size, below).otherwise(below + 1)


def seen(events: DataFrame, limits: list[int] | None, max_depth: int) -> list[Column]:
    """The columns of a signature: model, source_name, action, author_name, streams, deep."""
    message = Message(events)
    streams = F.lit(None)
    if message.has("entity"):
        def shape(stream: Column) -> Column:
            # only streams of content are measured
            measured = F.when(stream["label"] == V.CONTENT_LABEL, _place(stream["size"], limits))
            return F.struct(stream["label"].alias("label"), measured.alias("size"), stream["file_format"].alias("file_format"))

        streams = F.when(message.is_binary, F.transform("entity.datastreams", shape))
    subject = {c: F.when(message.has_subject, message.subject(path)) for c, path in
               (("source_name", "source.name"), ("action", "action"), ("author_name", "author.name"))}
    return [
        message.model.alias("model"), *[value.alias(c) for c, value in subject.items()],
        streams.cast("array<struct<label:string,size:bigint,file_format:string>>").alias("streams"),
        flag(filters.too_deep(events, max_depth).isNotNull()).alias("deep"),
    ]


def as_message(with_author: bool, with_content: bool) -> list[Column]:
    """The message fields that rules read, from the columns of a signature."""
    own = F.col("author_name") if with_author else F.lit(None).cast("string")
    parts = ["model", F.struct(F.col("source_name").alias("name")).alias("source"), "action", F.struct(own.alias("name")).alias("author")]
    return [*parts, F.struct(F.col("streams").alias("datastreams")).alias("entity")] if with_content else parts
