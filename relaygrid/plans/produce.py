"""Produce plans: stages that replace, drop or add messages.

Fan-out happens inside the row: a message and what it adds become one array
that is exploded, so the input is scanned once and not unioned with itself.
Added messages pass the later stages only.  Dropped messages stay in the frame,
marked with the stage that dropped them, until the plan is done.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relaygrid import vocabulary as V
from relaygrid.functions import identity
from relaygrid.functions.messages import Message
from relaygrid.operators import filters, inject, projections, purge

Stage = Callable[[DataFrame], DataFrame]
ID, DROPPED, ADDED = "msg_id", "dropped_by", "added_by"


def fan_out(df: DataFrame, extra: Column, columns: list[str] | None = None) -> DataFrame:
    """Each row followed by the rows in ``extra``, an array of the same struct."""
    own = F.array(F.struct(*(columns or df.columns)))
    rows = F.concat(own, F.coalesce(extra, F.slice(own, 1, 0)))
    return df.select(F.explode(rows).alias("m")).select("m.*")


def message_struct(df: DataFrame, values: dict[str, Column]) -> Column:
    """A row of ``df``'s shape; columns without a value are NULL."""
    return F.struct(*[
        values.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in df.schema.fields
    ])


class ProducePlan:
    def __init__(self, stages: list[tuple[str, Stage] | None]):
        self.stages = [s for s in stages if s is not None]

    def run(self, df: DataFrame, row_id: str = "seq") -> DataFrame:
        current = (
            df.withColumn(ID, F.col(row_id).cast("string"))
            .withColumn(DROPPED, F.lit(None).cast("string"))
            .withColumn(ADDED, F.lit(None).cast("string"))
        )
        for _, stage in self.stages:
            current = stage(current)
        return current


def survivors(ran: DataFrame) -> DataFrame:
    return ran.where(F.col(DROPPED).isNull()).drop(DROPPED)


def produce_counts(ran: DataFrame) -> DataFrame:
    """Messages removed and added, by stage."""
    stage = F.explode(F.array_compact(F.array(
        F.when(F.col(DROPPED).isNotNull(), F.struct(F.col(DROPPED).alias("stage"), F.lit("removed").alias("what"))),
        F.when(F.col(ADDED).isNotNull(), F.struct(F.col(ADDED).alias("stage"), F.lit("added").alias("what"))),
    ))).alias("s")
    return ran.select(stage).groupBy("s.stage").agg(
        F.count_if(F.col("s.what") == "removed").alias("removed"),
        F.count_if(F.col("s.what") == "added").alias("added"),
    )


def _drop_when(df: DataFrame, name: str, condition: Column) -> DataFrame:
    return df.withColumn(DROPPED, F.coalesce(DROPPED, F.when(condition, name)))


# --- the stages -----------------------------------------------------------------

def user_stage(
    name: str, drop: Callable[[DataFrame], Column] | None = None, replace: Callable[[DataFrame], dict[str, Column]] | None = None,
    additional: Callable[[DataFrame], Column] | None = None, row_id: str = "seq",
) -> tuple[str, Stage]:
    """A stage of one's own: drops a message, or changes its columns and sends further messages after it.

    ``additional`` gives an array of structs whose fields are columns of the
    message; the other columns of an added message are NULL.  Added messages
    keep the ``row_id`` of theirs and are seen by later stages only.  Messages
    dropped before are left alone.
    """

    def stage(df: DataFrame) -> DataFrame:
        current = df if drop is None else _drop_when(df, name, F.coalesce(drop(df), F.lit(False)))
        alive = F.col(DROPPED).isNull()
        if replace is not None:
            changed = {c: value.cast(df.schema[c].dataType) for c, value in replace(current).items()}
            current = current.withColumns({c: F.when(alive, value).otherwise(F.col(c)) for c, value in changed.items()})
        if additional is None:
            return current
        sent = additional(current)
        fields = current.select(sent.alias("sent")).schema["sent"].dataType.elementType.fieldNames()

        def added(r: Column, i: Column) -> Column:
            values = {c: r[c].cast(df.schema[c].dataType) for c in fields}
            own = {row_id: F.col(row_id), ID: F.concat_ws(".", F.col(ID), F.lit(name), i.cast("string")), ADDED: F.lit(name)}
            return message_struct(current, {**values, **own})

        return fan_out(current, F.when(alive, F.transform(sent, added)))

    return name, stage


def ageoff_stage(sources: DataFrame | None, now):
    if sources is None:
        return None

    def stage(df: DataFrame) -> DataFrame:
        dated = filters.with_expiry(df, sources)
        return _drop_when(dated, V.STAGE_AGEOFF, filters.ageoff(dated, now).isNotNull()).drop("expire_ms")

    return V.STAGE_AGEOFF, stage


def explode_results(df: DataFrame) -> DataFrame:
    """Completed statuses, stripped, followed by their results as messages."""
    if "status" not in df.columns:
        return df
    marked = df
    for name in (ID, DROPPED, ADDED):
        if name not in df.columns:
            marked = marked.withColumn(name, F.lit(None).cast("string"))
    alive = F.col(DROPPED).isNull()
    done = (Message(df).model == "status") & projections.is_completed(F.col("status")) & alive
    fields = {f.name for f in df.schema["status"].dataType["results"].dataType.elementType.fields}

    def result_row(r: Column, i: Column) -> Column:
        values = {c: r[c] for c in df.columns if c in fields}
        values["flags"] = projections.inherited_flags(F.col("status.input.flags"))
        values["model"] = F.lit("binary")
        if "seq" in df.columns:
            values["seq"] = F.col("seq")
        values[ID] = F.concat_ws(".", F.col(ID), i.cast("string"))
        values[ADDED] = F.lit(V.STAGE_RESULTS)
        return message_struct(marked, values)

    extra = F.when(done, F.transform("status.results", result_row))
    stripped = projections.strip_status_results(marked.withColumn("_extra", extra))
    return fan_out(stripped, F.col("_extra"), marked.columns).drop(*[c for c in (ID, DROPPED, ADDED) if c not in df.columns])


def results_stage():
    return V.STAGE_RESULTS, explode_results


def inject_stage(register: DataFrame | None, now):
    if register is None:
        return None

    def stage(df: DataFrame) -> DataFrame:
        out = inject.inject_children(df, register, now, row_id=ID)
        child = F.col("injected_key").isNotNull()
        return (
            out.withColumn(ID, F.concat_ws(".", ID, "injected_key"))
            .withColumn(ADDED, F.when(child, V.STAGE_INJECT).otherwise(F.col(ADDED)))
            .drop("injected_key")
        )

    return V.STAGE_INJECT, stage


def key_stage(run: str = ""):
    """``run`` tells the random keys of one run from those of another; within a run they do not change."""

    def stage(df: DataFrame) -> DataFrame:
        keyed = df.withColumn("kafka_key", identity.identity_expr(df, seed=F.concat(F.lit(f"{run}/"), F.col(ID))))
        return _drop_when(keyed, V.STAGE_KEY, F.col("kafka_key").isNull())

    return V.STAGE_KEY, stage


def deleted_stage(register: DataFrame | None):
    """On publish a purged message is only dropped; it has no log row to erase.

    The lookup reads the tokens of the fan-out once more, narrow, instead of
    storing it whole: keys do not change when they are computed again.
    """
    if register is None:
        return None

    def stage(df: DataFrame) -> DataFrame:
        judged = purge.judge_purged(df, register, row_id=ID)
        return _drop_when(judged, V.STAGE_DELETED, F.col("purged")).drop("purged")

    return V.STAGE_DELETED, stage


def settings_stage():
    return V.STAGE_SETTINGS, projections.strip_settings_at_depth


def publish_plan(now, sources=None, inserts=None, deletes=None) -> ProducePlan:
    """Settings take no part in deletions: stripped before that lookup, they need not bring the lineage through its join."""
    return ProducePlan([
        ageoff_stage(sources, now), results_stage(), inject_stage(inserts, now), key_stage(),
        settings_stage(), deleted_stage(deletes),
    ])


def rekey_plan() -> ProducePlan:
    """Lost-task statuses and reprocessed messages only get a new key."""
    return ProducePlan([key_stage()])
