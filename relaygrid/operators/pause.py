"""Pausing task consumers while somebody reprocesses."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relaygrid import vocabulary as V
from relaygrid.functions.messages import flag
from relaygrid.functions.ordered import SPLIT, carry_forward, range_splits
from relaygrid.session import settle


def pause_gate(
    requests: DataFrame, pauses: DataFrame, pause_s: int = V.PAUSE_S, skip_s: int = V.SKIP_TO_LATEST_S
) -> DataFrame:
    """Add ``gate``: ``paused``, ``latest`` or ``normal``, for each request.

    Time is cut into buckets that divide both windows, minutes at most.
    Whether a pause lies in the window before a request needs only the first
    and last pause of each bucket: whole buckets inside the window count by
    existing, the two border buckets by their first or last pause.  So pauses
    shrink to one row per bucket, spread over the buckets they reach, and each
    request looks up its own bucket; nothing is ranked or paired.
    """
    unit_s = math.gcd(60, pause_s, skip_s)
    unit = unit_s * 1_000_000
    at = F.unix_micros("paused_at")
    minutes = pauses.groupBy(F.floor(at / unit).cast("bigint").alias("m")).agg(
        F.min(at).alias("first"), F.max(at).alias("last")
    )
    reach = F.explode(F.sequence(F.lit(0), F.lit(skip_s // unit_s))).alias("back")
    spread = minutes.select("m", "first", "last", reach).withColumn("minute", F.col("m") + F.col("back"))

    def inside(window_s: int):
        return (F.col("back") > 0) & (F.col("back") < window_s // unit_s)

    def border(window_s: int):
        return F.max(F.when(F.col("back") == window_s // unit_s, F.col("last")))

    state = spread.groupBy("minute").agg(
        F.min(F.when(F.col("back") == 0, F.col("first"))).alias("_first_now"),
        F.bool_or(inside(pause_s)).alias("_in_pause"), border(pause_s).alias("_pause_border"),
        F.bool_or(inside(skip_s)).alias("_in_skip"), border(skip_s).alias("_skip_border"),
    )
    asked = F.unix_micros("requested_at")
    joined = requests.withColumn("minute", F.floor(asked / unit).cast("bigint")).join(state, "minute", "left")

    def within(window_s: int, whole: str, edge: str):
        return (
            flag(F.col("_first_now") <= asked) | flag(F.col(whole))
            | flag(F.col(edge) > asked - window_s * 1_000_000)
        )

    gate = (
        F.when(~flag(F.col("is_task")), "normal")
        .when(within(pause_s, "_in_pause", "_pause_border"), "paused")
        .when(within(skip_s, "_in_skip", "_skip_border"), "latest")
        .otherwise("normal")
    )
    return joined.select(*requests.columns, gate.alias("gate"))


def throttled_pauses(pauses: DataFrame, gap_s: int = V.PAUSE_GAP_S) -> DataFrame:
    """Pauses that are recorded: more than ``gap_s`` after the last recorded one.

    Each pause points at the first pause beyond its gap.  A pause after a longer
    silence is recorded for sure; the others are recorded when a recorded pause
    points at them.  Marks spread along the pointers, which double their reach
    each round, so a chain of n pauses takes about log2(n) joins on unique keys
    and no task ever folds the whole log.
    """
    gap = gap_s * 1_000_000
    instants = pauses.select(F.unix_micros("paused_at").alias("p")).distinct()
    nodes = settle(_with_next(_with_previous(instants), gap), "pauses")
    fresh = F.col("prev").isNull() | (F.col("p") - F.col("prev") > gap)
    roots = nodes.where(fresh).select("p")
    # pointers at pauses that are recorded anyway carry no news
    jump = settle(
        nodes.where(F.col("next").isNotNull()).select("p", "next")
        .join(roots.select(F.col("p").alias("next")), "next", "left_anti"),
        "pause-jumps",
    )
    marked = roots
    while not jump.isEmpty():
        reached = marked.join(jump, "p").select(F.col("next").alias("p"))
        marked = settle(marked.unionByName(reached).distinct(), "pause-marks")
        beyond = jump.select(F.col("p").alias("next"), F.col("next").alias("beyond"))
        jump = settle(jump.join(beyond, "next").select("p", F.col("beyond").alias("next")), "pause-jumps")
    return marked.select(F.timestamp_micros("p").alias("paused_at"))


def reprocess_marks(runs: DataFrame, every_s: int = 60) -> DataFrame:
    """Pauses recorded while somebody reprocesses: at the start of each run and every ``every_s`` seconds until it ends.

    ``runs`` has ``started_at, ended_at``; a run that ends before it starts leaves no mark.
    """
    start, end = F.unix_micros("started_at"), F.unix_micros("ended_at")
    steps = F.sequence(F.lit(0).cast("bigint"), F.floor((end - start) / (every_s * 1_000_000)).cast("bigint"))
    marks = runs.where(start <= end).select("started_at", F.explode(steps).alias("n"))
    return marks.select(F.timestamp_micros(F.unix_micros("started_at") + F.col("n") * every_s * 1_000_000).alias("paused_at"))


def _with_previous(instants: DataFrame) -> DataFrame:
    cut = range_splits(instants, [], ["p"], "pause-order")
    return carry_forward(cut, [], ["p"], F.col("p"), "prev", include_current=False).drop(SPLIT)


def _with_next(instants: DataFrame, gap: int) -> DataFrame:
    """Add ``next``: the first instant beyond ``p + gap``, walking time backwards."""
    asks = instants.select("p", "prev", (-(F.col("p") + gap)).alias("back"), F.lit(0).alias("side"))
    offers = instants.select("p", F.lit(None).cast("bigint").alias("prev"), (-F.col("p")).alias("back"), F.lit(1).alias("side"))
    cut = range_splits(asks.unionByName(offers), [], ["back", "side", "p"], "pause-next")
    offered = F.when(F.col("side") == 1, F.col("p"))
    met = carry_forward(cut, [], ["back", "side", "p"], offered, "next", include_current=False)
    return met.where(F.col("side") == 0).select("p", "prev", "next")
