"""Exact dedup: group by a 128-bit hash of the text, keep the smallest id, compare bytes inside groups.

Native: DataFrame functions only.

* Each map task first collapses its rows by (hash, text), so a text that fills
  a third of the table crosses the network once per task.  The text is part of
  the grouping key, hence its bytes are compared, and two texts that share a
  hash stay two groups ("variants").
* Rows find their variant by (hash, second digest), two narrow columns.  Only
  variants that share both, which no known pair of texts does, are told apart
  by the text itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relaygrid.llm.common import BLANKS, carried
from relaygrid.session import settle


def normal_text(text: Column) -> Column:
    """Null as empty; each run of blanks as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")


def content_hash(norm: Column) -> Column:
    """128-bit content hash."""
    return F.md5(norm.cast("binary"))


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hasher=content_hash) -> DataFrame:
    """One row per distinct text: hash, sha, keep_id, group_size, and twin (its place among texts with both digests)."""
    rows = docs.select(F.col(id_col).alias("id"), normal_text(F.col(text_col)).alias("norm"))
    found = (
        rows.select("id", hasher(F.col("norm")).alias("hash"), "norm")
        .groupBy("hash", "norm")
        .agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    )
    return found.select("hash", F.sha2(F.col("norm").cast("binary"), 256).alias("sha"), "keep_id", "group_size", "norm")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hasher=content_hash) -> DataFrame:
    """Which row of equal texts stays.

    One row per input row: ``id_col``, keep_id, group_size, kept, text_sha256.

    * Null text counts as empty.  Texts are equal when identical after each run
      of blanks became one space.
    * ``kept`` marks exactly one row of a group: the one with the smallest id;
      null ids come last.  Of rows that repeat both id and text, one is kept.
    * An empty table gives an empty result; other columns of ``docs``, whatever
      their names, take no part.
    """
    groups = settle(variants(docs, id_col, text_col, hasher).drop("norm"), "exact-variants")
    rows = docs.select(F.col(id_col).alias("id"), normal_text(F.col(text_col)).alias("norm"))
    rows = rows.select("id", hasher(F.col("norm")).alias("hash"), F.sha2(F.col("norm").cast("binary"), 256).alias("sha"), "norm")
    twins = groups.groupBy("hash", "sha").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    if twins.isEmpty():
        # every (hash, sha) stands for one text whose bytes were compared
        counted = rows.groupBy("id", "hash", "sha").agg(F.count(F.lit(1)).alias("times"))
        matched = counted.join(groups, ["hash", "sha"])
    else:
        full = variants(docs, id_col, text_col, hasher)
        counted = rows.groupBy("id", "hash", "sha", "norm").agg(F.count(F.lit(1)).alias("times"))
        matched = counted.join(full, ["hash", "sha", "norm"])
    # rows repeated in full are counted once and written out again
    nth = F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))
    return matched.select("id", "keep_id", "group_size", "sha", nth.alias("nth")).select(
        F.col("id").alias(id_col), "keep_id", "group_size",
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that :func:`exact_dedup` drops; columns as they were."""
    key = F.struct(F.col("id"), F.col("sha")).alias("key")  # never null, so a null id is a key as any other
    kept = exact_dedup(docs, id_col, text_col).where("kept").select(F.col(id_col).alias("id"), F.col("text_sha256").alias("sha")).select(key)
    rows = docs.select(carried(docs), F.col(id_col).alias("id"), F.sha2(normal_text(F.col(text_col)).cast("binary"), 256).alias("sha"))
    # rows that repeat both id and text are one document; the join has dealt them by that key already
    return rows.select("row", key).join(kept, "key", "left_semi").dropDuplicates(["key"]).select("row.*")
