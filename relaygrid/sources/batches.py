"""Client bodies to messages: JSON objects or lists of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relaygrid import schemas
from relaygrid import vocabulary as V
from relaygrid.functions.identity import CLOCK

_BROKEN = "_broken"


@dataclass(frozen=True)
class ParsedBatches:
    """``batches`` has one row per body with ``batch_error`` and ``items``."""

    batches: DataFrame

    def ok(self) -> DataFrame:
        good = F.filter("items", lambda i: i["error"].isNull())
        rows = self.batches.where(F.col("batch_error").isNull()).select("batch_id", F.explode(good).alias("i"))
        return rows.select("batch_id", F.col("i.position").alias("position"), "i.event.*")

    def messages(self, model: str) -> DataFrame:
        """The accepted events as message rows, with the submission time as written."""
        good = F.filter("items", lambda i: i["error"].isNull())
        rows = self.batches.where(F.col("batch_error").isNull()).select("batch_id", F.explode(good).alias("i"))
        clock = F.get_json_object("i.raw", "$.source.timestamp") if model in ("binary", "download") else F.lit(None).cast("string")
        rows = rows.select("batch_id", F.col("i.position").alias("position"), F.lit(model).alias("model"), clock.alias(CLOCK), "i.event.*")
        return rows if model == "binary" else rows.withColumnRenamed("entity", model)

    def failures(self) -> DataFrame:
        bad = F.filter("items", lambda i: i["error"].isNotNull())
        rows = self.batches.where(F.col("batch_error").isNull()).select("batch_id", F.explode(bad).alias("i"))
        return rows.select("batch_id", "i.position", "i.error", "i.raw")

    def summary(self) -> DataFrame:
        accepted = F.col("batch_error").isNull()

        def counted(keep) -> Column:
            return F.when(accepted, F.size(F.filter("items", keep))).otherwise(0)

        return self.batches.select(
            "batch_id", "batch_error",
            counted(lambda i: i["error"].isNull()).alias("total_ok"),
            counted(lambda i: i["error"].isNotNull()).alias("total_failures"),
        )


def validity_error(event: Column, model: str) -> Column:
    """What is wrong with a decoded event; NULL when it is acceptable."""

    def missing(value: Column, name: str) -> Column:
        return F.when(F.coalesce(value, F.lit("")) == "", f"missing {name}")

    if model == "binary":
        return F.coalesce(
            missing(event["source"]["name"], "source name"),
            missing(event["action"], "action"),
            F.when(~event["action"].isin(*V.ACTIONS), "unknown action"),
            missing(event["entity"]["sha256"], "entity sha256"),
            F.when(F.coalesce(F.size(event["source"]["path"]), F.lit(0)) <= 0, "empty lineage"),
        )
    if model == "status":
        return missing(event["entity"]["status"], "status")
    if model == "insert":
        return missing(event["entity"]["parent_sha256"], "parent sha256")
    return F.lit(None).cast("string")


def parse_event_batches(bodies: DataFrame, model: str, current_version: int = V.CURRENT_MODEL_VERSION) -> ParsedBatches:
    """Parse bodies (``batch_id, body``) of one model.

    A body fails as a whole when it is too small, is not JSON, or holds an
    event that does not decode or has an old version; only validity failures
    are per event.  A body is one row and stays one row until it is judged, so
    nothing is shuffled or regrouped.
    """
    fields = [*schemas.BY_MODEL[model].fields, T.StructField(_BROKEN, T.StringType())]
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BROKEN}
    texts = T.ArrayType(T.StringType())
    # in brackets, anything but exactly one JSON value shows: text after it,
    # a second value, an unclosed list
    outer = F.from_json(F.concat(F.lit("["), F.col("body"), F.lit("]")), texts)
    valid = F.coalesce(F.size(outer) == 1, F.lit(False))
    is_list = F.ltrim("body").startswith("[")
    raws = F.when(valid & is_list, F.from_json(outer[0], texts)).when(valid, outer)
    decoded = F.transform(
        raws,
        lambda raw, i: F.struct(
            i.alias("position"), raw.alias("raw"), F.from_json(raw, T.StructType(fields), options).alias("event")
        ),
    )

    def outdated(item: Column) -> Column:
        event = item["event"]
        undecoded = event.isNull() | event[_BROKEN].isNotNull()
        return undecoded | (F.coalesce(event["model_version"], F.lit(0)) < current_version)

    batch_error = F.coalesce(
        F.when(F.coalesce(F.octet_length("body"), F.lit(0)) <= 2, "event message too small"),
        F.when(~valid, "event message invalid json"),
        F.when(F.exists("decoded", outdated), "event message version was too old or was corrupt"),
    )
    items = F.transform(
        "decoded",
        lambda d: F.struct(
            d["position"].alias("position"), d["raw"].alias("raw"),
            d["event"].dropFields(_BROKEN).alias("event"), validity_error(d["event"], model).alias("error"),
        ),
    )
    judged = bodies.select("batch_id", "body", decoded.alias("decoded")).select(
        "batch_id", batch_error.alias("batch_error"), items.alias("items")
    )
    return ParsedBatches(judged)


def reject_outdated_batches(events: DataFrame, batch: str = "batch_id", current_version: int = V.CURRENT_MODEL_VERSION) -> DataFrame:
    """For events already split into rows: drop every batch holding an
    undecodable (NULL version) or outdated one.

    Bad batches are found by a partial aggregate and removed by an anti join.
    """
    bad = F.coalesce(F.col("model_version"), F.lit(0)) < current_version
    outdated = events.where(bad).select(batch).distinct()
    return events.join(outdated, batch, "left_anti")
