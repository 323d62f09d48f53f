"""Manual inserts: child messages attached to the parents they name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from relaygrid import vocabulary as V
from relaygrid.functions.messages import Message, depth, flag, from_end
from relaygrid.operators.filters import instant
from relaygrid.session import settle


def latest_inserts(inserts: DataFrame) -> DataFrame:
    """Per parent and insert key the insert that arrived last.

    A NULL payload removes the insert of that key from every parent.
    """
    # an insert without a key can neither be told from others nor taken back
    inserts = inserts.where(F.col("kafka_key").isNotNull())
    live = inserts.where(F.col("insert").isNotNull()).withColumn("parent_sha256", F.col("insert.parent_sha256"))
    # positions first: payloads are neither compared nor sorted
    newest = live.groupBy("parent_sha256", "kafka_key").agg(F.max("seq").alias("seq"))
    removed = inserts.where(F.col("insert").isNull()).groupBy("kafka_key").agg(F.max("seq").alias("_removed"))
    last = newest.join(removed, "kafka_key", "left").where(F.col("_removed").isNull() | (F.col("seq") > F.col("_removed")))
    return live.join(settle(last.select("seq"), "last-inserts"), "seq", "left_semi").select("parent_sha256", "kafka_key", "seq", "insert")


def injectable(df: DataFrame) -> Column:
    """Messages that bring a new entity, not one more look at the same entity."""
    path = F.col("source.path")
    changed = from_end(path["sha256"], 0) != from_end(path["sha256"], 1)
    fresh = (depth(path) < 2) | flag(changed)
    return flag(Message(df).is_binary & F.col("action").isin(*V.ACTIONS_WITH_DATA) & fresh)


def inject_children(df: DataFrame, register: DataFrame, now, row_id: str = "seq") -> DataFrame:
    """Each message followed by one child per insert registered for it.

    One pass: a parent meets its inserts in a left join, and the join row of
    the smallest insert key also emits the parent itself.  ``register`` is the
    output of :func:`latest_inserts`, best settled.  Adds ``injected_key``, the
    insert a child comes from; a child keeps the ``row_id`` of its parent.
    """
    register = register.where(F.col("kafka_key").isNotNull())
    first = register.groupBy("parent_sha256").agg(F.min("kafka_key").alias("_first"))
    side = register.join(first, "parent_sha256").select(
        F.col("parent_sha256").alias("_parent"), F.col("kafka_key").alias("_insert"),
        (F.col("kafka_key") == F.col("_first")).alias("_is_first"),
        F.col("insert.child").alias("_child"), F.col("insert.child_history").alias("_history"),
    )
    alive = F.col("dropped_by").isNull() if "dropped_by" in df.columns else F.lit(True)
    # rows that take no child get a key of their own: NULLs would share one task
    nothing = F.concat(F.lit("-/"), F.col(row_id).cast("string"))
    target = F.when(injectable(df) & alive, F.col("entity.sha256")).otherwise(nothing)
    joined = df.withColumn("_target", target).join(side, F.col("_target") == F.col("_parent"), "left")

    of_child = {**child_fields(df.schema, now), row_id: F.col(row_id), "seq": F.col("seq")}
    fields = df.schema.fields
    child = F.struct(
        *[of_child.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in fields],
        F.col("_insert").alias("injected_key"),
    )
    own = F.struct(*[F.col(f.name) for f in fields], F.lit(None).cast("string").alias("injected_key"))
    matched = F.col("_insert").isNotNull()
    rows = (
        F.when(~matched, F.array(own)).when(F.col("_is_first"), F.array(own, child)).otherwise(F.array(child))
    )
    return joined.select(F.explode(rows).alias("m")).select("m.*")


def child_fields(schema: StructType, now) -> dict[str, Column]:
    """Fields of a child, over its parent's ``source`` and the insert's ``_child`` and ``_history``.

    Fields a child does not set (key, flags, tracking) start empty.
    """
    path_type = schema["source"].dataType["path"].dataType
    path = F.array_append(F.coalesce(F.col("source.path"), F.array().cast(path_type)), F.col("_history"))
    return {
        "model": F.lit("binary"), "model_version": F.lit(V.CURRENT_MODEL_VERSION), "timestamp": instant(now),
        "author": F.col("_history.author"), "action": F.col("_history.action"), "entity": F.col("_child"),
        "source": F.col("source").withField("path", path),
    }


def settle_register(inserts: DataFrame) -> DataFrame:
    return settle(latest_inserts(inserts), "inserts")
