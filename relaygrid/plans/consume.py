"""Consume plans: ordered stages, the first one to object names the reason.

Column stages are expressions on the wide rows.  Table stages (deletions,
repeats, replays) need lookups; they run on a narrow copy of the surviving
binaries that is written once, and their verdicts come back in a single join
on the unique row id.  So the wide rows are scanned twice and shuffled at most
once, however many stages a plan has.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relaygrid import vocabulary as V
from relaygrid.functions.messages import Message
from relaygrid.operators import dedupe as repeats
from relaygrid.operators import filters, projections, purge, replay, security
from relaygrid.operators.consumers import ConsumerSpec
from relaygrid.session import settle


@dataclass(frozen=True)
class ColumnStage:
    """``reason(df)`` is a Column; ``prepare(df)`` may attach lookup columns."""

    name: str
    reason: Callable[[DataFrame], Column]
    prepare: Callable[[DataFrame], DataFrame] | None = None
    helpers: tuple[str, ...] = ()


@dataclass(frozen=True)
class TableStage:
    """``verdict(narrow)`` returns ``narrow`` with a column ``verdict``."""

    name: str
    verdict: Callable[[DataFrame], DataFrame]


class ConsumePlan:
    """Stages that are None (switched off) are left out of the plan."""

    def __init__(self, stages: list[ColumnStage | TableStage | None]):
        self.stages = [s for s in stages if s is not None]
        kinds = [isinstance(s, TableStage) for s in self.stages]
        self._columns_first = kinds.index(True) if True in kinds else len(kinds)

    def run(self, df: DataFrame, row_id: str = "seq") -> DataFrame:
        """Add ``reason``: ``Stage-reason`` of the first objection, else NULL.

        Column stages speak on the wide rows, whatever their place; the order
        is resolved last.  A table stage sees what is alive at its place.
        """
        judged = df
        said = {}
        for place, stage in enumerate(self.stages):
            if isinstance(stage, ColumnStage):
                prepared = stage.prepare(judged) if stage.prepare else judged
                said[place] = f"_said{place}"
                judged = prepared.withColumn(said[place], _objection(stage, stage.reason(prepared))).drop(*stage.helpers)
        none = F.lit(None).cast("string")
        head = [name for place, name in said.items() if place < self._columns_first]
        rest = [name for place, name in said.items() if place > self._columns_first]
        judged = judged.withColumn("reason", F.coalesce(none, *head)).drop(*head)
        if self._columns_first == len(self.stages):
            return judged
        narrow = settle(narrow_messages(judged.where(F.col("reason").isNull()), row_id, rest), "survivors")
        for place, stage in list(enumerate(self.stages))[self._columns_first :]:
            if place in said:
                narrow = narrow.withColumn("reason", F.coalesce("reason", said[place]))
            else:
                narrow = _apply_table(narrow, stage)
        verdicts = narrow.where(F.col("reason").isNotNull()).select(row_id, F.col("reason").alias("_late"))
        late = F.when(Message(judged).is_binary, F.col("_late")).otherwise(F.coalesce(none, *rest))
        return (
            judged.join(settle(verdicts, "verdicts"), row_id, "left")
            .withColumn("reason", F.coalesce("reason", late)).drop("_late", *rest)
        )


def _objection(stage, reason: Column) -> Column:
    return F.when(reason.isNotNull(), F.concat(F.lit(f"{stage.name}-"), reason))


def _apply_table(narrow: DataFrame, stage: TableStage) -> DataFrame:
    judged = stage.verdict(narrow)
    return judged.withColumn("reason", F.coalesce("reason", _objection(stage, F.col("verdict")))).drop("verdict")


def narrow_messages(df: DataFrame, row_id: str = "seq", more: list[str] | None = None) -> DataFrame:
    """The parts of binary messages that lookups read, and ``more``."""
    source = F.struct(*[F.col(f"source.{c}").alias(c) for c in ("name", "security", "timestamp")])
    return df.where(Message(df).is_binary).select(
        row_id, Message(df).model.alias("model"), "kafka_key", "timestamp", "action", "author", "flags",
        source.alias("source"), F.struct(F.col("entity.sha256").alias("sha256")).alias("entity"),
        "track_source_references", "track_links", "track_authors", "reason", *(more or []),
    )


# --- the stages ---------------------------------------------------------------

def depth_stage(limit: int) -> ColumnStage:
    return ColumnStage(V.STAGE_DEPTH, lambda df: filters.too_deep(df, limit))


def ageoff_stage(sources: DataFrame | None, now) -> ColumnStage | None:
    if sources is None:
        return None
    return ColumnStage(
        V.STAGE_AGEOFF, lambda df: filters.ageoff(df, now),
        prepare=lambda df: filters.with_expiry(df, sources), helpers=("expire_ms",),
    )


def security_stage(spec: ConsumerSpec, scheme: security.LabelScheme | None) -> ColumnStage | None:
    if scheme is None or not spec.max_security:
        return None
    limit = F.lit(spec.max_security)

    def prepare(df: DataFrame) -> DataFrame:
        pairs = security.label_pairs(df, limit)
        return security.with_access(df, settle(security.security_access(pairs, scheme), "access"), limit)

    return ColumnStage(
        V.STAGE_SECURITY, lambda df: security.security_filter(df, limit), prepare=prepare, helpers=("allowed",)
    )


def rules_stage(spec: ConsumerSpec) -> ColumnStage:
    return ColumnStage(V.STAGE_RULES, lambda df: filters.consumer_rules(df, spec.column()))


def deleted_stage(register: DataFrame | None, row_id: str = "seq") -> TableStage | None:
    if register is None:
        return None

    def verdict(narrow: DataFrame) -> DataFrame:
        judged = purge.judge_purged(narrow, register, row_id=row_id, settled=False)
        return judged.withColumn("verdict", purge.purge_reason()).drop("purged")

    return TableStage(V.STAGE_DELETED, verdict)


def duplicates_stage(enabled: bool, row_id: str = "seq") -> TableStage | None:
    """One consumer at a time, so the message key alone identifies a repeat."""
    if not enabled:
        return None

    def verdict(narrow: DataFrame) -> DataFrame:
        alive = F.col("reason").isNull()
        return repeats.first_seen(narrow, [], row_id, alive).withColumnRenamed("dedupe_reason", "verdict")

    return TableStage(V.STAGE_DUPLICATES, verdict)


def replay_stage(spec: ConsumerSpec, statuses: DataFrame | None, ttl_s: float, row_id: str = "seq") -> TableStage | None:
    if statuses is None:
        return None

    def verdict(narrow: DataFrame) -> DataFrame:
        alive = narrow.where(F.col("reason").isNull())
        consumer = (F.lit(spec.name), F.lit(spec.version))
        mine = replay.of_consumer(statuses, spec.name, spec.version)
        hits = replay.match_completions(alive, mine, consumer, ttl_s, row_id)
        return narrow.join(hits, row_id, "left").withColumn(
            "verdict", F.when(F.col("status_id").isNotNull(), V.CACHED)).drop("status_id")

    return TableStage(V.STAGE_REPLAY, verdict)


def dequeued_stage(spec: ConsumerSpec) -> ColumnStage:
    return ColumnStage(V.STAGE_DEQUEUED, lambda df: projections.dequeue_reason(df, spec.column()))


# --- the shipped plans ----------------------------------------------------------

@dataclass(frozen=True)
class ConsumeContext:
    """Tables and settings the plans draw on; what is None is switched off."""

    now: object
    sources: DataFrame | None = None
    scheme: security.LabelScheme | None = None
    deletes: DataFrame | None = None
    dedupe: bool = False
    statuses: DataFrame | None = None
    replay_ttl_s: float = V.REPLAY_TTL_S
    # unique column that orders messages by arrival; statuses carry it too
    row_id: str = "seq"


def active_plan(spec: ConsumerSpec, ctx: ConsumeContext) -> ConsumePlan:
    return ConsumePlan([
        ageoff_stage(ctx.sources, ctx.now), depth_stage(V.DEPTH_ACTIVE), security_stage(spec, ctx.scheme),
        rules_stage(spec), deleted_stage(ctx.deletes, ctx.row_id), duplicates_stage(ctx.dedupe, ctx.row_id),
        replay_stage(spec, ctx.statuses, ctx.replay_ttl_s, ctx.row_id), dequeued_stage(spec),
    ])


def passive_plan(spec: ConsumerSpec, ctx: ConsumeContext) -> ConsumePlan:
    return ConsumePlan([
        ageoff_stage(ctx.sources, ctx.now), depth_stage(V.DEPTH_PASSIVE), security_stage(spec, ctx.scheme),
        rules_stage(spec), deleted_stage(ctx.deletes, ctx.row_id), duplicates_stage(ctx.dedupe, ctx.row_id),
    ])


def simulate_plan(spec: ConsumerSpec) -> ConsumePlan:
    return ConsumePlan([depth_stage(V.DEPTH_PASSIVE), rules_stage(spec)])
