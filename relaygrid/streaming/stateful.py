"""First-seen messages on a stream, in Spark's own operator."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relaygrid.functions.messages import text
from relaygrid.operators.dedupe import dedupe_applies
from relaygrid.streaming.keyed import CLOCK


def dedupe_stream(stream: DataFrame, consumer: list[str], ttl: str, arrived=None) -> DataFrame:
    """First message per consumer and key; repeats within ``ttl`` of its arrival are dropped.

    ``ttl`` is how long a key is remembered at least, by the clock at which rows
    arrive (``arrived``: a column; the time of the batch by default); Spark drops
    it after a batch whose clock is another ``ttl`` further.  A message's own timestamp
    plays no part, so none is too late to be judged: each row comes out or is a
    repeat of one that did.  Expedited and cache-bypassing binaries
    and other models never are repeats and pass beside the state.  Binaries
    without a key are dropped.
    """
    applies = dedupe_applies(stream)
    exempt = stream.where(~applies)
    keyed = stream.where(applies & (text(F.col("kafka_key")) != ""))
    clock = F.current_timestamp() if arrived is None else arrived
    kept = keyed.withColumn(CLOCK, clock).withWatermark(CLOCK, ttl).dropDuplicatesWithinWatermark([*consumer, "kafka_key"])
    return kept.drop(CLOCK).unionByName(exempt)
