"""Deletions: the register they form and the messages they purge.

All four kinds of deletion share one lookup.  A message lists the tokens it can
be deleted by, the register holds at most one row per (kind, token), so the
lookup joins once instead of once per kind, and no pairs multiply.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relaygrid import vocabulary as V
from relaygrid.functions.messages import Message, flag
from relaygrid.session import settle

BY_ID, BY_LINK, BY_AUTHOR, BY_SUBMISSION = "ids", "link", "author", "submission"
KINDS = (BY_ID, BY_LINK, BY_AUTHOR, BY_SUBMISSION)
_NO_TIME = "timestamp"


def entries(deletes: DataFrame) -> DataFrame:
    """One row per (kind, token, bound) a delete message registers."""
    entity = F.col("entity")

    def entry(token: Column, bound: Column) -> Column:
        return F.struct(token.alias("token"), bound.cast(_NO_TIME).alias("bound"))

    never = F.lit(None)
    by_ids = F.transform(entity["ids"]["ids"], lambda i: entry(i, never))
    single = (
        F.when(F.col("action") == BY_LINK, entry(entity["link"]["track_link"], never))
        .when(F.col("action") == BY_AUTHOR, entry(entity["author"]["track_author"], entity["author"]["timestamp"]))
        .when(
            F.col("action") == BY_SUBMISSION,
            entry(entity["submission"]["track_source_references"], entity["submission"]["timestamp"]),
        )
    )
    listed = F.when(F.col("action") == BY_ID, by_ids).otherwise(F.array(single))
    return deletes.select("seq", F.col("action").alias("kind"), F.explode(listed).alias("e")).where(
        F.col("kind").isin(*KINDS) & F.col("e.token").isNotNull()
    ).select("seq", "kind", "e.token", "e.bound")


def latest_deletes(deletes: DataFrame) -> DataFrame:
    """Register: per (kind, token) the deletion that arrived last."""
    newest = F.max(F.struct("seq", "bound"))
    return entries(deletes).groupBy("kind", "token").agg(newest.alias("n")).select(
        "kind", "token", F.col("n.bound").alias("bound"), F.col("n.seq").alias("seq")
    )


def tokens(kinds=KINDS) -> Column:
    """Everything a message can be deleted by, with the instant to compare."""

    def token(kind: str, value: Column, at: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), value.alias("token"), at.cast(_NO_TIME).alias("at"))

    none = F.lit(None)
    per_kind = {
        BY_ID: lambda: F.array(token(BY_ID, F.col("kafka_key"), none)),
        BY_LINK: lambda: F.transform("track_links", lambda v: token(BY_LINK, v, none)),
        BY_AUTHOR: lambda: F.transform("track_authors", lambda v: token(BY_AUTHOR, v, F.col("timestamp"))),
        BY_SUBMISSION: lambda: F.array(
            token(BY_SUBMISSION, F.col("track_source_references"), F.col("source.timestamp"))
        ),
    }
    empty = F.array().cast("array<struct<kind:string,token:string,at:timestamp>>")
    return F.concat(*[F.coalesce(per_kind[k](), empty) for k in kinds])


def purged_rows(df: DataFrame, register: DataFrame, kinds=KINDS, row_id: str = "seq") -> DataFrame:
    """Distinct ids of the messages some deletion of ``kinds`` purges."""
    narrow = df.where(Message(df).is_binary).select(row_id, F.explode(tokens(kinds)).alias("t")).select(
        row_id, "t.kind", "t.token", "t.at"
    )
    holds = (
        F.when(F.col("kind") == BY_AUTHOR, F.col("at") < F.col("bound"))
        .when(F.col("kind") == BY_SUBMISSION, F.col("bound").isNull() | (F.col("bound") == F.col("at")))
        .otherwise(F.lit(True))
    )
    wanted = register.where(F.col("kind").isin(*kinds)).select("kind", "token", "bound")
    return narrow.join(wanted, ["kind", "token"]).where(holds).select(row_id).distinct()


def judge_purged(
    df: DataFrame, register: DataFrame, kinds=KINDS, row_id: str = "seq", settled: bool = True
) -> DataFrame:
    """Add ``purged``.

    The purged ids are settled first: usually few, they then come back without
    a shuffle of the messages; many come back in a shuffled join.
    """
    hits = purged_rows(df, register, kinds, row_id)
    hits = settle(hits, "purged") if settled else hits
    marked = df.join(hits.withColumn("_hit", F.lit(True)), row_id, "left")
    return marked.withColumn("purged", flag(F.col("_hit"))).drop("_hit")


def drop_purged(df: DataFrame, register: DataFrame, kinds=KINDS, row_id: str = "seq") -> DataFrame:
    """Messages no deletion of ``kinds`` touches."""
    return df.join(settle(purged_rows(df, register, kinds, row_id), "purged"), row_id, "left_anti")


def purge_by_id(df, register):
    return drop_purged(df, register, (BY_ID,))


def purge_by_link(df, register):
    return drop_purged(df, register, (BY_LINK,))


def purge_by_author(df, register):
    return drop_purged(df, register, (BY_AUTHOR,))


def purge_by_submission(df, register):
    return drop_purged(df, register, (BY_SUBMISSION,))


def purge_reason() -> Column:
    """Expects ``purged``."""
    return F.when(flag(F.col("purged")), V.DELETED)


def tombstones(df: DataFrame) -> DataFrame:
    """Log rows that erase purged messages; expects ``purged`` and ``topic``."""
    return df.where("purged").select(
        "topic", F.col("kafka_key").alias("key"), F.lit(None).cast("string").alias("value")
    )


def settle_register(deletes: DataFrame) -> DataFrame:
    """The whole register, loaded before anything is judged against it."""
    return settle(latest_deletes(deletes), "deletes")
