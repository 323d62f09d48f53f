"""Operational roll-ups.  All are partial aggregates, so hot groups are cheap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relaygrid import vocabulary as V
from relaygrid.functions.messages import text
from relaygrid.operators.filters import instant


def stage_counts(judged: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Dropped messages by stage and reason; expects ``reason`` = stage-reason."""
    stage = F.substring_index("reason", "-", 1)
    cause = F.regexp_replace("reason", "^[^-]*-", "")
    dropped = judged.where(F.col("reason").isNotNull())
    return dropped.groupBy(*(by or []), stage.alias("stage"), cause.alias("cause")).agg(F.count("*").alias("removed"))


def fetch_info(judged: DataFrame, by: list[str]) -> DataFrame:
    """Per request: fetched, filtered and the count of each reason.

    Counts per reason first, then folds the few reasons of a request.
    """
    counted = judged.groupBy(*by, "reason").agg(F.count("*").alias("n"))
    dropped = F.col("reason").isNotNull()
    pairs = F.array_sort(F.collect_list(F.when(dropped, F.struct("reason", "n"))))
    return counted.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(~dropped, F.col("n"))), F.lit(0)).alias("fetched"),
        F.coalesce(F.sum(F.when(dropped, F.col("n"))), F.lit(0)).alias("filtered"),
        F.map_from_entries(pairs).alias("filters"),
    )


def publish_stats(published: DataFrame) -> dict[str, DataFrame]:
    """Published messages by author and model, by topic, by author; statuses by
    author and label without those of category user."""
    by_user = F.lower(text(F.col("author.category"))) == "user"
    statuses = published.where((F.col("model") == "status") & ~by_user)
    author = F.col("author.name").alias("author")
    count = F.count("*").alias("n")
    return {
        "by_author_model": published.groupBy(author, "model").agg(count),
        "by_status": statuses.groupBy(author, F.col("status.status").alias("status")).agg(count),
        "by_topic": published.groupBy("topic").agg(count),
        "by_author": published.groupBy(author).agg(count),
    }


def consume_stats(requests: DataFrame, judged: DataFrame) -> DataFrame:
    """Requests, fetched and filtered by consumer and model."""
    by = ["consumer", "model"]
    asked = requests.groupBy(*by).agg(F.count("*").alias("requests"))
    got = judged.groupBy(*by).agg(
        F.count_if(F.col("reason").isNull()).alias("fetched"),
        F.count_if(F.col("reason").isNotNull()).alias("filtered"),
    )
    zero = F.lit(0)
    return asked.join(got, by, "full").select(
        *by, F.coalesce("requests", zero).alias("requests"),
        F.coalesce("fetched", zero).alias("fetched"), F.coalesce("filtered", zero).alias("filtered"),
    )


def bucket_counts(value: Column, buckets) -> Column:
    """Array aggregate of cumulative bucket rows (le, count)."""
    rows = [
        F.struct(F.lit(float(b)).alias("le"), F.count_if(value <= float(b)).alias("n")) for b in sorted(buckets)
    ]
    return F.array(*rows, F.struct(F.lit(float("inf")).alias("le"), F.count(value).alias("n")))


def histogram(df: DataFrame, value: Column, buckets, by: list[Column | str]) -> DataFrame:
    """Cumulative buckets with sum and count.

    Every bound is one counter of the same aggregate, so a value is read once
    and never copied per bucket.
    """
    return df.groupBy(*by).agg(
        bucket_counts(value, buckets).alias("buckets"), F.sum(value).alias("sum"), F.count(value).alias("count")
    )


def histogram_rows(hist: DataFrame, by: list[str]) -> DataFrame:
    return hist.select(*by, F.inline("buckets"))


def access_log_rollup(log: DataFrame, buckets=V.REST_BUCKETS) -> DataFrame:
    """Per method and route: requests, errors (status >= 400) and durations."""
    seconds = F.col("duration_s").try_cast("double")
    failed = F.count_if(F.col("status") >= 400)
    return log.groupBy("method", "route").agg(
        F.count("*").alias("requests"), failed.alias("errors"),
        (failed / F.count("*")).alias("error_share"),
        F.sum(seconds).alias("duration_sum"), bucket_counts(seconds, buckets).alias("buckets"),
    )


def access_log_codes(log: DataFrame) -> DataFrame:
    return log.groupBy("method", "route", "status").agg(F.count("*").alias("n"))


def volume_stats(log: DataFrame) -> DataFrame:
    """Messages and bytes by topic."""
    size = F.coalesce(F.octet_length("value"), F.lit(0)) + F.coalesce(F.octet_length("key"), F.lit(0))
    return log.groupBy("topic").agg(F.count("*").alias("messages"), F.sum(size).cast("bigint").alias("bytes"))


def blob_volume(transfers: DataFrame) -> DataFrame:
    """Uploads and downloads with their bytes; expects ``direction, size``."""
    return transfers.groupBy("direction").agg(F.count("*").alias("blobs"), F.sum("size").alias("bytes"))


def idle_consumers(requests: DataFrame, now, idle_after_s: int = V.IDLE_AFTER_S) -> DataFrame:
    """Consumers whose last request is longer ago than the limit."""
    last = requests.groupBy("consumer").agg(F.max("requested_at").alias("last_request"))
    age = F.unix_micros(instant(now)) - F.unix_micros("last_request")
    return last.where(age > idle_after_s * 1_000_000)


def unidentified_formats(blobs: DataFrame) -> DataFrame:
    """Blobs nobody could identify, by MIME type and magic."""
    return blobs.where(F.col("file_format") == "unknown").groupBy("mime", "magic").agg(F.count("*").alias("n"))


def reprocess_stats(reprocessed: DataFrame, log: DataFrame | None = None) -> DataFrame:
    """Messages per source topic, and in all in a row whose topic is NULL.

    With the ``log`` that was read, also its rows (``total``) per topic and
    whether the end was reached (``at_end``): the last offset of each of its
    partitions is among what was processed or was left out before.
    """
    done = reprocessed.rollup("source_topic").agg(F.count("*").alias("processed"))
    if log is None:
        return done
    ends = log.groupBy("topic", "partition").agg(F.max("offset").alias("end"), F.count("*").alias("n"))
    reached = reprocessed.groupBy(F.col("source_topic").alias("topic"), "partition").agg(F.max("offset").alias("reached"))
    state = ends.join(reached, ["topic", "partition"], "left")
    totals = state.rollup(F.col("topic").alias("source_topic")).agg(
        F.sum("n").alias("total"), F.bool_and(F.coalesce(F.col("reached") >= F.col("end"), F.lit(False))).alias("at_end"))
    return totals.join(done, totals["source_topic"].eqNullSafe(done["source_topic"]), "left").select(
        totals["source_topic"], F.coalesce("processed", F.lit(0)).alias("processed"), "total", "at_end")
