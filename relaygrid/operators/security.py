"""Security labels: who may see what.

Decisions are made once per distinct (limit, label) pair and joined back, so
the label text is parsed as often as there are labels, not as there are rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relaygrid import vocabulary as V
from relaygrid.functions.messages import Message, flag, text


@dataclass(frozen=True)
class LabelScheme:
    """Classification levels with priority, caveats, groups, markings."""

    levels: dict[str, int]
    caveats: tuple[str, ...] = ()
    groups: tuple[str, ...] = ()
    group_prefix: str = "REL:"
    markings: tuple[str, ...] = field(default_factory=tuple)


def _word(pattern: str) -> str:
    return rf"(?<!\S)(?:{pattern})(?!\S)"


def _normal(label: Column) -> Column:
    return F.upper(F.trim(text(label)))


def _level(label: Column, scheme: LabelScheme) -> Column:
    # longest names first: one name may end in another
    names = sorted(scheme.levels, key=len, reverse=True)
    found = [F.when(label.rlike(_word(re.escape(n))), F.lit(scheme.levels[n])) for n in names]
    return F.coalesce(*found)


def _caveats(label: Column, scheme: LabelScheme) -> Column:
    found = [F.when(label.rlike(_word(re.escape(n))), F.lit(n)) for n in scheme.caveats]
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def _groups(label: Column, scheme: LabelScheme) -> Column:
    listed = F.regexp_extract_all(label, F.lit(re.escape(scheme.group_prefix) + r"(\S+)"), F.lit(1))
    return F.flatten(F.transform(listed, lambda g: F.split(g, ",")))


def _has_unknown(label: Column, scheme: LabelScheme) -> Column:
    fixed = sorted((*scheme.levels, *scheme.caveats, *scheme.markings), key=len, reverse=True)
    known = [re.escape(n) for n in fixed] + [re.escape(scheme.group_prefix) + r"\S+"]
    return F.trim(F.regexp_replace(label, _word("|".join(known)), "")) != ""


def access_expr(limit: Column, label: Column, scheme: LabelScheme) -> Column:
    """True when ``limit`` allows ``label``; anything unclear is denied."""
    limit, label = _normal(limit), _normal(label)
    groups = _groups(label, scheme)
    names = F.array(*[F.lit(g.removeprefix(scheme.group_prefix)) for g in scheme.groups]) if scheme.groups else None
    unknown_group = F.size(F.array_except(groups, names)) > 0 if names is not None else F.size(groups) > 0
    return flag(
        ~_has_unknown(limit, scheme) & ~_has_unknown(label, scheme) & ~unknown_group
        & (_level(label, scheme) <= _level(limit, scheme))
        & (F.size(F.array_except(_caveats(label, scheme), _caveats(limit, scheme))) == 0)
        & ((F.size(groups) == 0) | F.arrays_overlap(groups, _groups(limit, scheme)))
    )


def label_pairs(df: DataFrame, limit: Column) -> DataFrame:
    """Distinct (limit, label) pairs of the messages that carry a label."""
    return df.select(limit.alias("max_security"), F.col("source.security").alias("security")).distinct()


def security_access(pairs: DataFrame, scheme: LabelScheme) -> DataFrame:
    allowed = access_expr(F.col("max_security"), F.col("security"), scheme)
    return pairs.withColumn("allowed", allowed)


def with_access(df: DataFrame, access: DataFrame, limit: Column) -> DataFrame:
    """Attach ``allowed``; pairs without a decision stay NULL."""
    decided = access.select(
        F.col("max_security").alias("_limit"), F.col("security").alias("_label"), "allowed"
    )
    return (
        df.withColumn("_limit", limit).withColumn("_label", F.col("source.security"))
        .join(decided, ["_limit", "_label"], "left").drop("_limit", "_label")
    )


def security_filter(df: DataFrame, limit: Column) -> Column:
    """Expects ``allowed`` (see :func:`with_access`); no decision means no access."""
    applies = (
        Message(df).model.isin("binary", "download")
        & (text(limit) != "") & (text(F.col("source.security")) != "")
    )
    return F.when(applies & ~flag(F.col("allowed")), V.MAX_SECURITY)
