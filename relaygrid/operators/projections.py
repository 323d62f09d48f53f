"""Row-by-row changes to messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relaygrid import vocabulary as V
from relaygrid.functions.messages import Message, depth, flag, text
from relaygrid.operators.filters import instant

_NO_SETTINGS = "map<string,string>"


def strip_settings_at_depth(df: DataFrame) -> DataFrame:
    """Empty the source settings once the lineage is as long as they ask for."""
    asked = F.col("source.settings")[V.SETTINGS_DEPTH_KEY]
    limit = F.when(asked.rlike(r"^[+-]?[0-9]+$"), asked.try_cast("bigint"))
    reached = flag(Message(df).is_binary & (depth(F.col("source.path")) >= limit))
    emptied = F.create_map().cast(_NO_SETTINGS)
    settings = F.when(reached, emptied).otherwise(F.col("source.settings"))
    return df.withColumn("source", F.col("source").withField("settings", settings))


def dequeued_id(spec: Column, now) -> Column:
    epoch = F.unix_seconds(instant(now)).cast("string")
    return F.concat_ws(".", F.col("kafka_key"), spec["name"], spec["version"], epoch)


def dequeue_reason(df: DataFrame, spec: Column) -> Column:
    tracked = flag(spec["is_task"]) & Message(df).is_binary
    return F.when(tracked & (text(F.col("kafka_key")) == ""), V.NO_ID)


def stamp_dequeued(df: DataFrame, spec: Column, now) -> DataFrame:
    """Give each task its id; only task consumers and binaries are stamped."""
    tracked = flag(spec["is_task"]) & Message(df).is_binary & (text(F.col("kafka_key")) != "")
    return df.withColumn("dequeued", F.when(tracked, dequeued_id(spec, now)).otherwise(F.col("dequeued")))


def task_start_record(df: DataFrame) -> DataFrame:
    """The copy kept while a task runs: bulky entity parts emptied."""
    entity = F.col("entity")
    types = {f.name: f.dataType for f in df.schema["entity"].dataType.fields}
    trimmed = (
        entity.withField("features", F.array().cast(types["features"]))
        .withField("datastreams", F.array().cast(types["datastreams"]))
        .withField("info", F.lit(None).cast(types["info"]))
    )
    return df.withColumn("entity", trimmed)


def is_completed(status: Column, completed=V.STATUS_COMPLETED) -> Column:
    return flag(status["status"].isin(*completed))


def strip_status_results(df: DataFrame, completed=V.STATUS_COMPLETED) -> DataFrame:
    """Completed statuses lose their results; others keep what they carry."""
    status = F.col("status")
    emptied = status.withField("results", F.lit(None).cast(_results_type(df)))
    done = (Message(df).model == "status") & is_completed(status, completed)
    return df.withColumn("status", F.when(done, emptied).otherwise(status))


def _results_type(df: DataFrame):
    return next(f.dataType for f in df.schema["status"].dataType.fields if f.name == "results")


def inherited_flags(flags: Column, replayed: bool = False) -> Column:
    """Flags a result takes from its input; a replayed one only ``expedite``."""
    bypass = F.lit(False) if replayed else flag(flags["bypass_cache"])
    return F.struct(
        bypass.alias("bypass_cache"), flag(flags["expedite"]).alias("expedite"), F.lit(False).alias("retry")
    )


def inherit_flags(df: DataFrame) -> DataFrame:
    """Every result of a completed status with the flags of the status's input."""
    results = F.transform(
        F.col("status.results"),
        lambda r: r.withField("flags", inherited_flags(F.col("status.input.flags"))),
    )
    return df.withColumn("status", F.col("status").withField("results", results))
