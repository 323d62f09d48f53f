"""Fetching: what a consumer receives next, and why the rest is held back."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from relaygrid import schemas
from relaygrid import vocabulary as V
from relaygrid.functions import routing
from relaygrid.functions.identity import CLOCK
from relaygrid.operators import metrics, oplog, projections, purge, replay
from relaygrid.operators.consumers import ConsumerSpec
from relaygrid.operators.filters import drop_tombstones
from relaygrid.operators.layout import SEGMENT, StoredLog
from relaygrid.plans.consume import ConsumeContext, active_plan, passive_plan
from relaygrid.plans.decode import decode_messages
from relaygrid.session import settle

ROW_ID = "delivery"
#: The first window of a fetch in multiples of its count, and how windows grow.
FIRST_WINDOW, GROWTH = 8, 8
#: Rows that a second of a fetch's deadline stands for.
ROWS_PER_S = 100_000


@dataclass(frozen=True)
class Feed:
    name: str
    priority: int
    start: str
    pattern: str


def feeds(spec: ConsumerSpec, naming: routing.Naming = routing.DEFAULT_NAMING) -> list[Feed]:
    """The feeds of one consumer, best first."""
    if spec.model == "binary":
        own = routing.binary_topic_pattern(spec.require_sources, spec.require_events, naming)
    else:
        own = routing.exact_topic_pattern(naming.system(spec.model))
    wanted = []
    if spec.model == "binary" and spec.require_expedite:
        wanted.append(Feed("expedite", 0, "latest", routing.exact_topic_pattern(naming.expedite)))
    if spec.require_live:
        wanted.append(Feed("live", 1, "latest", own))
    if spec.require_historic:
        wanted.append(Feed("historic", 2, "earliest", own))
    return wanted


def delivery_id(priority: Column) -> Column:
    """Unique text id that sorts in delivery order."""

    def digits(value: Column, width: int) -> Column:
        return F.lpad(value.cast("string"), width, "0")

    return F.concat_ws(
        "/", priority.cast("string"), digits(F.unix_micros("ts"), 20), F.col("topic"),
        digits(F.col("partition"), 10), digits(F.col("offset"), 20),
    )


def deliveries(
    log: DataFrame | StoredLog, offsets: DataFrame, consumer_key: str, spec: ConsumerSpec,
    naming: routing.Naming = routing.DEFAULT_NAMING,
) -> DataFrame:
    """Unread log rows of all feeds of a consumer, with feed and priority.

    One scan and one lookup: the progress of all feeds is one row per
    partition, and a row is copied to the feeds whose pattern and progress
    admit it.  Of a stored log, only segments that hold such rows are opened.
    """
    chosen = feeds(spec, naming)
    groups = {f"{naming.root}-{consumer_key}-{feed.name}": feed for feed in chosen}
    progress = offsets.where(F.col("consumer_group").isin(*groups)).groupBy(*oplog.PARTITION).agg(*[
        F.max(F.when(F.col("consumer_group") == group, F.col("committed"))).alias(f"_read_{feed.name}")
        for group, feed in groups.items()
    ])
    progress = settle(progress, "progress")

    def admits(feed: Feed, offset: str) -> Column:
        known = F.col(f"_read_{feed.name}")
        unread = F.col(offset) >= (F.coalesce(known, F.lit(0)) if feed.start == "earliest" else known)
        return F.col("topic").rlike(feed.pattern) & F.coalesce(unread, F.lit(False))

    # the topics of all feeds first: a log stored by topic opens these folders only
    wanted = F.col("topic").rlike("|".join(f"(?:{feed.pattern})" for feed in chosen))
    if isinstance(log, StoredLog):
        held = log.segments.where(wanted).join(progress, oplog.PARTITION, "left")
        readers = sum((admits(feed, "last").cast("int") for feed in chosen), F.lit(0))
        log = log.only(held.select(SEGMENT, readers.alias("readers")), F.col("readers") > 0)
    log = log.where(wanted)
    rows = log.join(progress, oplog.PARTITION, "left")
    admitted = [
        F.when(admits(feed, "offset"), F.struct(F.lit(feed.name).alias("feed"), F.lit(feed.priority).alias("priority")))
        for feed in chosen
    ]
    spread = rows.withColumn("_f", F.explode(F.array_compact(F.array(*admitted))))
    return spread.select(*log.columns, "_f.feed", "_f.priority").withColumn(ROW_ID, delivery_id(F.col("priority")))


def decode_binary(log: DataFrame) -> DataFrame:
    """Log rows to binary message rows; tombstones and corrupt values are skipped."""
    decoded = decode_messages(drop_tombstones(log), F.lit("binary"))
    return decoded.select(*[c for c in log.columns if c != "value"], "model", *schemas.BINARY.fieldNames(), CLOCK)


@dataclass(frozen=True)
class Fetched:
    """``judged``: the candidates a fetch looked at, with their reason; ``delivered``: the answer.

    ``last``: order values of the last message handed out, if the answer is
    full; candidates after it do not count as examined.  ``bound``: those of
    the last candidate looked at, if there are more behind it.
    """

    judged: DataFrame
    delivered: DataFrame
    order: tuple[str, ...]
    last: Row | None
    ctx: ConsumeContext
    spec: ConsumerSpec
    paused: bool = False
    bound: Row | None = None

    def examined(self) -> DataFrame:
        """Candidates up to the last message handed out; none while paused."""
        if self.paused:
            return self.judged.where(F.lit(False))
        return self.judged if self.last is None else self.judged.where(_up_to(self.judged, self.order, self.last))

    @property
    def position(self) -> Row | None:
        """Where the next fetch goes on (``after``); None if nothing is left behind it."""
        return self.last or self.bound

    def info(self) -> DataFrame:
        """One row: fetched, filtered, the count of each reason among the examined, ready and paused."""
        counted = metrics.fetch_info(self.examined(), [])
        return counted.withColumns({"ready": F.lit(not self.paused), "paused": F.lit(self.paused)})

    def task_starts(self) -> DataFrame:
        return projections.task_start_record(self.delivered)

    def _dropped(self, stage: str, reason: str) -> DataFrame:
        return self.examined().where(F.col("reason") == f"{stage}-{reason}")

    def replayed(self) -> DataFrame:
        """Results re-emitted for the examined messages that an earlier run answers."""
        events = self._dropped(V.STAGE_REPLAY, V.CACHED).drop("reason")
        if self.ctx.statuses is None:
            return events
        mine = replay.of_consumer(self.ctx.statuses, self.spec.name, self.spec.version)
        consumer = (F.lit(self.spec.name), F.lit(self.spec.version))
        matches = replay.settle_matches(replay.match_completions(events, mine, consumer, self.ctx.replay_ttl_s, self.ctx.row_id))
        return replay.replay_completions(events, mine, matches, self.ctx.now, self.ctx.row_id)[1]

    def tombstones(self) -> DataFrame:
        """Log rows that erase the examined messages some deletion purged; candidates need ``topic``."""
        return purge.tombstones(self._dropped(V.STAGE_DELETED, V.DELETED).withColumn("purged", F.lit(True)))


def _values(df: DataFrame, order: Sequence[str], at: Row) -> Column:
    return F.struct(*[F.lit(at[c]).cast(df.schema[c].dataType).alias(c) for c in order])


def _up_to(df: DataFrame, order: Sequence[str], at: Row) -> Column:
    """Rows not after ``at``; the first column also on its own, which a scan can skip files by."""
    lead = F.col(order[0])
    return (lead.isNull() | (lead <= F.lit(at[order[0]]).cast(df.schema[order[0]].dataType))) & (F.struct(*order) <= _values(df, order, at))


def _after(df: DataFrame, order: Sequence[str], at: Row) -> Column:
    behind = F.struct(*order) > _values(df, order, at)
    if at[order[0]] is None:  # nulls come first
        return behind
    return (F.col(order[0]) >= F.lit(at[order[0]]).cast(df.schema[order[0]].dataType)) & behind


def fetch(
    messages: DataFrame, spec: ConsumerSpec, ctx: ConsumeContext, order: list[str], gate: str = "normal",
    after: Row | None = None, rows_per_s: int = ROWS_PER_S,
) -> Fetched:
    """Judge candidate messages in order until ``spec.count`` survive, and hand these out.

    Candidates are judged in a window of the first rows by ``order``; while too
    few survive, the window grows by a factor of :data:`GROWTH`, so what is
    judged is in proportion to what is examined and not to the backlog.  The
    first window is a multiple of the count.  A fetch ends when the answer is
    full, nothing is left, or ``spec.deadline`` seconds are spent: a budget of
    ``rows_per_s`` examined rows each (no deadline, no budget), so that the
    result does not depend on the machine.

    ``after``: the ``position`` of an earlier fetch to go on from.  Repeats are
    judged among the rows one fetch looks at.  Windows are found on the order
    columns alone; only the few chosen ids, whose number the fetch limit
    bounds, go back to the wide messages.  A consumer whose ``gate`` (see
    ``operators.pause``) is ``paused`` gets nothing.
    """
    plan = active_plan(spec, ctx) if spec.is_task else passive_plan(spec, ctx)
    paused = gate == "paused"
    messages = messages.where(F.lit(False)) if paused else messages
    if after is not None:
        messages = messages.where(_after(messages, order, after))
    wanted = oplog.pull_count(spec.count)
    budget = spec.deadline * rows_per_s if spec.deadline > 0 else None
    size = FIRST_WINDOW * wanted
    while True:
        size = size if budget is None else min(size, budget)
        places = settle(messages.select(*order).orderBy(*order).limit(size + 1), "window")
        more = places.count() > size
        bound = places.orderBy(*order).limit(size).orderBy(*[F.col(c).desc() for c in order]).first() if more else None
        window = messages.where(_up_to(messages, order, bound)) if more else messages
        judged = settle(plan.run(window, ctx.row_id).select(ctx.row_id, *[c for c in order if c != ctx.row_id], "reason"), "judged")
        kept = judged.where(F.col("reason").isNull())
        # no more rows than one fetch may hand out
        chosen = settle(oplog.priority_pull(kept, spec.count, order), "chosen")
        full = chosen.count() >= wanted
        if full or not more or size == budget:
            break
        size *= GROWTH
    last = chosen.orderBy(*[F.col(c).desc() for c in order]).select(*order).first() if full else None
    pulled = window.join(chosen.select(ctx.row_id), ctx.row_id, "left_semi").orderBy(*order)
    stamped = projections.stamp_dequeued(pulled, spec.column(), ctx.now)
    said = window.join(judged.select(ctx.row_id, "reason"), ctx.row_id)
    return Fetched(said, stamped, tuple(order), last, ctx, spec, paused, bound)
