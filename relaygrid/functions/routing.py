"""Topic names, topic patterns and topic choice."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relaygrid import vocabulary as V
from relaygrid.functions.messages import Message, flag, text

_ANY_PART = r"[^\.]+"


@dataclass(frozen=True)
class Naming:
    """Names are ``<root>.<namespace>.<source>.binary.<action>`` or
    ``<root>.<namespace>.system.<model>``."""

    root: str = "grid"
    namespace: str = "main"

    @property
    def prefix(self) -> str:
        return f"{self.root}.{self.namespace}"

    def system(self, model: str) -> str:
        return f"{self.prefix}.system.{model}"

    @property
    def expedite(self) -> str:
        return self.system("expedite")

    @property
    def retry(self) -> str:
        return self.system("error")


DEFAULT_NAMING = Naming()


def check_actions(actions) -> list[str]:
    unknown = [a for a in actions or [] if a not in V.ACTIONS]
    if unknown:
        raise ValueError(f"unknown binary action: {', '.join(unknown)}")
    return list(actions or [])


def exact_topic_pattern(topic: str) -> str:
    return f"^{re.escape(topic)}$"


def binary_topic_pattern(sources=None, actions=None, naming: Naming = DEFAULT_NAMING) -> str:
    """Regular expression for the binary topics of some sources and actions."""
    actions = check_actions(actions)
    source = f"({'|'.join(sources)})" if sources else _ANY_PART
    action = f"({'|'.join(actions)})" if actions else _ANY_PART
    return rf"^{re.escape(naming.root)}\.{naming.namespace}\.{source}\.binary\.{action}$"


def binary_topic_pattern_expr(sources: Column, actions: Column, naming: Naming = DEFAULT_NAMING) -> Column:
    """The same pattern when sources and actions are columns."""

    def part(values: Column) -> Column:
        return F.when(
            F.size(values) > 0, F.concat(F.lit("("), F.array_join(values, "|"), F.lit(")"))
        ).otherwise(F.lit(_ANY_PART))

    head = rf"^{re.escape(naming.root)}\.{naming.namespace}\."
    return F.concat(F.lit(head), part(sources), F.lit(r"\.binary\."), part(actions), F.lit("$"))


def topic_expr(df: DataFrame, naming: Naming = DEFAULT_NAMING) -> Column:
    """Topic a message is written to; NULL when source or action is missing."""
    msg = Message(df)
    system = F.when(~msg.is_binary, F.concat(F.lit(f"{naming.prefix}.system."), msg.model))
    if not msg.has("source"):  # a table of other models only
        return system
    complete = (text(F.col("source.name")) != "") & (text(F.col("action")) != "")
    own = F.concat(F.lit(f"{naming.prefix}."), F.col("source.name"), F.lit(".binary."), F.col("action"))
    return (
        system.when(flag(F.col("flags.expedite")), naming.expedite)
        .when(flag(F.col("flags.retry")), naming.retry)
        .when(complete, own)
    )


def choose_topic(df: DataFrame, naming: Naming = DEFAULT_NAMING) -> DataFrame:
    return df.withColumn("topic", topic_expr(df, naming))


def model_of_topic(topic: Column, system_profile: bool) -> Column:
    """Model held by a topic: source topics hold binaries, as does expedite."""
    if not system_profile:
        return F.lit("binary")
    name = F.regexp_extract(topic, r".*\.system\.(.*)", 1)
    return F.when(name == "expedite", "binary").otherwise(name)
