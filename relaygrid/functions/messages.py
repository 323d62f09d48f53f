"""Access to the parts of a message row.

A message row carries ``model`` plus the binary fields at the top level and,
where the table has other models, a nullable struct per payload (``status``,
``plugin``, ``insert``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Message:
    """Names the columns of a message DataFrame; builds expressions only."""

    def __init__(self, df: DataFrame):
        self.columns = set(df.columns)

    def has(self, name: str) -> bool:
        return name in self.columns

    @property
    def model(self) -> Column:
        return F.col("model") if self.has("model") else F.lit("binary")

    @property
    def is_binary(self) -> Column:
        return self.model == "binary"

    @property
    def has_subject(self) -> Column:
        """Binary messages, and statuses, which speak about their input."""
        return self.model.isin("binary", "status")

    def subject(self, path: str) -> Column:
        """Field of the binary the message is about."""
        if not self.has("status"):
            return F.col(path)
        of_status = F.when(self.model == "status", F.col(f"status.input.{path}"))
        # a table of statuses alone has no binary columns
        return of_status.otherwise(F.col(path)) if self.has(path.split(".")[0]) else of_status


def text(column: Column) -> Column:
    """NULL strings behave as empty ones."""
    return F.coalesce(column, F.lit(""))


def array_length(array: Column) -> Column:
    """Length of an array, 0 when NULL."""
    return F.when(array.isNull(), F.lit(0)).otherwise(F.size(array))


def from_end(array: Column, back: int) -> Column:
    """Element ``back`` steps before the last one; NULL when there is none."""
    return F.get(array, array_length(array) - 1 - back)


def depth(path: Column) -> Column:
    """Length of a lineage, read from one leaf so that a scan skips the others."""
    return array_length(path["sha256"])


def flag(column: Column) -> Column:
    return F.coalesce(column, F.lit(False))
