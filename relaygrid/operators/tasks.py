"""Tasks that were handed out and never reported back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relaygrid import vocabulary as V
from relaygrid.functions.content import epoch_of_id
from relaygrid.functions.messages import text
from relaygrid.operators.filters import instant


def finished_ids(statuses: DataFrame) -> DataFrame:
    """Task ids some final status names; in-progress labels do not finish."""
    done = ~F.coalesce(F.col("status.status").isin(*V.STATUS_IN_PROGRESS), F.lit(False))
    return statuses.where(done & (text(F.col("status.input.dequeued")) != "")).select(
        F.col("status.input.dequeued").alias("dequeued")
    )


def lost_tasks(
    starts: DataFrame, finishes: DataFrame, now,
    lost_after_s: int = V.LOST_AFTER_S, ttl_s: int | None = None,
) -> DataFrame:
    """Starts that are overdue, unfinished and still tracked.

    The start time is read from the task id, so no payload is decoded for
    tasks that are not lost.  Both age limits prune before the anti join.
    """
    ttl_s = 2 * lost_after_s if ttl_s is None else ttl_s
    now_s = F.unix_seconds(instant(now))
    started = epoch_of_id(F.col("dequeued"))
    overdue = starts.where((started < now_s - lost_after_s) & (started > now_s - ttl_s))
    return overdue.join(finishes.select("dequeued"), "dequeued", "left_anti")


def lost_task_statuses(lost: DataFrame, now) -> DataFrame:
    """One failure status per lost task; the task itself is never resubmitted."""
    inputs = [c for c in lost.columns if c not in ("model", "seq", "status")]
    author = F.col("author")
    status = F.struct(
        F.struct(*inputs).alias("input"), F.lit(V.STATUS_LOST).alias("status"),
        F.concat(F.lit("lost task: "), F.col("dequeued")).alias("error"),
    )
    return lost.select(
        F.lit("status").alias("model"), F.lit(V.CURRENT_MODEL_VERSION).alias("model_version"),
        instant(now).alias("timestamp"),
        F.struct(author["category"].alias("category"), author["name"].alias("name"),
                 author["version"].alias("version")).alias("author"),
        status.alias("status"),
    )


def task_stats(
    starts: DataFrame, finishes: DataFrame, now, lost_after_s: int = V.LOST_AFTER_S, by: list[str] | None = None
) -> DataFrame:
    """Started, finished, lost and in-flight counts."""
    by = by or []
    done = finishes.select("dequeued").distinct().withColumn("_done", F.lit(True))
    started = epoch_of_id(F.col("dequeued"))
    overdue = started < F.unix_seconds(instant(now)) - lost_after_s
    judged = starts.join(done, "dequeued", "left").withColumn("_open", F.col("_done").isNull())
    return judged.groupBy(*by).agg(
        F.count("*").alias("started"), F.count_if(~F.col("_open")).alias("finished"),
        F.count_if(F.col("_open") & overdue).alias("lost"),
        F.count_if(F.col("_open") & ~overdue).alias("in_flight"),
    )
