"""Publishing: finalise, route, encode, check, write."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relaygrid import schemas
from relaygrid import vocabulary as V
from relaygrid.functions.identity import CLOCK, dotted_entries
from relaygrid.functions.messages import Message, text
from relaygrid.functions.routing import DEFAULT_NAMING, Naming, topic_expr


def author_token(author: Column) -> Column:
    return F.concat_ws(".", text(author["category"]), text(author["name"]), text(author["version"]))


# fixed values: how tokens write an instant, and one that is missing
_STAMP, _NO_STAMP = "yyyy_MM_dd'T'HH_mm_ss'Z_00'", "0001_01_01T00_00_00Z_00"


def link_token(parent_sha256: Column, child_sha256: Column, timestamp: Column, author: Column) -> Column:
    """Token of one edge: parent, child, when (UTC) and by whom, the author written as in :func:`author_token`."""
    stamp = F.coalesce(F.date_format(timestamp, _STAMP), F.lit(_NO_STAMP))
    return F.concat_ws(".", text(parent_sha256), text(child_sha256), stamp, author_token(author))


def finalise_tracking(df: DataFrame) -> DataFrame:
    """Fill the tokens deletions look for, from source and lineage; other models keep theirs."""
    path = F.col("source.path")
    links = F.transform(
        F.slice(path, 2, F.greatest(F.size(path) - 1, F.lit(0))),
        lambda node, i: link_token(F.get(path, i)["sha256"], node["sha256"], node["timestamp"], node["author"]),
    )
    references = F.concat(text(F.col("source.name")), F.lit("."), dotted_entries(F.col("source.references")))
    found = {
        "track_authors": F.array_distinct(F.transform(path, lambda n: author_token(n["author"]))),
        "track_links": F.when(F.size(path) > 1, F.array_distinct(links)).otherwise(F.array().cast("array<string>")),
        "track_source_references": references,
    }
    binary = Message(df).is_binary
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return df.withColumns({
        name: F.when(binary, token).otherwise(F.col(name) if name in kinds else F.lit(None)) for name, token in found.items()
    })


def _insert_tokens() -> dict[str, Column]:
    body = F.col("insert")
    made_by = body["child_history"]["author"]
    return {
        "track_author": author_token(made_by),
        "track_link": link_token(body["parent_sha256"], body["child"]["sha256"], body["child_history"]["timestamp"], made_by),
    }


# instants keep their microseconds
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def encode(df: DataFrame) -> Column:
    """JSON text of a message, by model: the fields its own schema reads back, without empty ones.

    The submission time is written as it came (``source_clock``), if known.
    """
    have = set(df.columns)

    def text_of(model: str) -> Column:
        fields = []
        for f in schemas.BY_MODEL[model].fieldNames():
            if f == "entity" and model != "binary":
                fields.append(F.col(model).alias("entity"))
            elif f == "source" and CLOCK in have and "source" in have:
                written = F.col("source").withField("timestamp", F.coalesce(CLOCK, F.date_format("source.timestamp", _JSON["timestampFormat"])))
                fields.append(F.when(F.col("source").isNotNull(), written).alias("source"))
            elif model == "insert" and f in ("track_author", "track_link"):
                fields.append(_insert_tokens()[f].alias(f))
            elif f in have:
                fields.append(F.col(f))
        return F.to_json(F.struct(*fields), _JSON)

    model = Message(df).model
    value = F.when(model == "binary", text_of("binary")) if have & set(schemas.BINARY.fieldNames()) - set(schemas.HEADER) else F.when(F.lit(False), "")
    for name in schemas.BY_MODEL:
        if name != "binary" and name in have:
            value = value.when(model == name, text_of(name))
    return value


@dataclass(frozen=True)
class Published:
    """Every message with ``topic``, ``value`` and ``reject_reason``."""

    judged: DataFrame

    @property
    def routed(self) -> DataFrame:
        return self.judged.where(F.col("reject_reason").isNull()).drop("reject_reason")

    @property
    def rejected(self) -> DataFrame:
        return self.judged.where(F.col("reject_reason").isNotNull())

    def report(self) -> DataFrame:
        """Messages per reject reason; NULL counts the good ones."""
        return self.judged.groupBy("reject_reason").agg(F.count("*").alias("n"))


def publish(df: DataFrame, naming: Naming = DEFAULT_NAMING, max_bytes: int = V.MAX_MESSAGE_BYTES) -> Published:
    """Finalise tracking, route and size-check; every bad message is reported, the rest go on."""
    df = finalise_tracking(df) if "source" in df.columns else df
    sized = df.withColumn("topic", topic_expr(df, naming)).withColumn("value", encode(df))
    size = F.octet_length("value")
    reason = (
        F.when(F.col("topic").isNull(), "missing source or action")
        .when(size > max_bytes, "message too large")
        .when(F.coalesce(size, F.lit(0)) == 0, "message had no length")
    )
    return Published(sized.withColumn("reject_reason", reason))


def write_published(published: Published, log_path: str, rejects_path: str) -> None:
    """Good messages to the log by topic, bad ones to a dead-letter table."""
    rows = published.routed.select("topic", F.col("kafka_key").alias("key"), "value")
    rows.write.mode("append").partitionBy("topic").parquet(log_path)
    published.rejected.select("kafka_key", "reject_reason", "value").write.mode("append").parquet(rejects_path)
