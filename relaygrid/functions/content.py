"""Content hashes, byte ranges and parameter parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_hashes(data: Column, minimal: bool = False) -> list[Column]:
    """Columns describing some bytes; only sha256 and size when ``minimal``."""
    size = F.octet_length(data).cast("bigint")
    columns = [F.sha2(data, 256).alias("sha256"), size.alias("size")]
    if not minimal:
        columns += [F.sha2(data, 512).alias("sha512"), F.sha1(data).alias("sha1"), F.md5(data).alias("md5")]
    empty = size == 0
    return columns + [
        F.when(empty, "inode/x-empty").alias("mime"),
        F.when(empty, "empty").alias("magic"),
        F.when(empty, "unknown").alias("file_format"),
    ]


def parse_byte_range(header: Column) -> Column:
    """struct(start, length, error) of a single byte range.

    No header reads everything; ``a-`` reads to the end (length -1); ``-n``
    reads the last n bytes (start -n).
    """
    header = F.coalesce(header, F.lit(""))
    body = F.trim(header.substr(F.lit(7), F.length(header)))
    dash = F.instr(body, "-")
    left = F.trim(F.substring_index(body, "-", 1))
    right = F.trim(body.substr(dash + 1, F.length(body)))
    start, end = left.try_cast("bigint"), right.try_cast("bigint")
    dashes = F.length(body) - F.length(F.replace(body, F.lit("-"), F.lit("")))
    number = r"^[+-]?[0-9]+$"
    start = F.when(left.rlike(number), start)
    end = F.when(right.rlike(number), end)
    error = (
        F.when(header == "", F.lit(None).cast("string"))
        .when(~header.startswith("bytes="), "no bytes= prefix")
        .when(header.contains(","), "multiple not supported")
        .when(dashes > 1, "relative with range not supported")
        .when((dash == 0) | (body == "-"), "no range")
        .when((left == "") & end.isNull(), "invalid end")
        .when((left != "") & start.isNull(), "non numeric")
        .when((left != "") & (right != "") & (end.isNull() | (start > end)), "invalid end")
    )
    first = F.when(header == "", F.lit(0)).when(left == "", -end).otherwise(start)
    length = (
        F.when(header == "", F.lit(-1)).when(left == "", end)
        .when(right == "", F.lit(-1)).otherwise(end - start + 1)
    )
    ok = error.isNull()
    return F.struct(
        F.when(ok, first.cast("bigint")).alias("start"),
        F.when(ok, length.cast("bigint")).alias("length"),
        error.alias("error"),
    )


def slice_bytes(data: Column, start: Column, length: Column) -> Column:
    """Bytes ``start``.. of ``data``; negative start counts from the end."""
    size = F.octet_length(data).cast("bigint")
    begin = F.when(start < 0, F.greatest(size + start, F.lit(0))).otherwise(start)
    count = F.when(length < 0, F.greatest(size - begin, F.lit(0))).otherwise(length)
    return F.substring(data, (begin + 1).cast("int"), count.cast("int"))


def epoch_of_id(dequeued: Column) -> Column:
    """Start time (epoch seconds) kept as the last dotted part of a task id."""
    return F.element_at(F.split(dequeued, r"\."), -1).try_cast("bigint")


def parse_flag(raw: Column) -> Column:
    """Boolean of a query parameter: absent is false, nonsense is NULL."""
    # fixed values: accepted spellings
    yes = ("1", "t", "T", "true", "TRUE", "True")
    no = ("0", "f", "F", "false", "FALSE", "False")
    return (
        F.when(F.coalesce(raw, F.lit("")) == "", False)
        .when(raw.isin(*yes), True).when(raw.isin(*no), False)
    )


def parse_count(raw: Column, default: int) -> Column:
    """Integer of a query parameter: absent is the default, nonsense is NULL."""
    return F.when(F.coalesce(raw, F.lit("")) == "", F.lit(default)).when(
        raw.rlike(r"^[+-]?[0-9]+$"), raw.try_cast("bigint")
    ).cast("bigint")


def parse_stream_requirements(raw: Column) -> Column:
    """``label,prefix,prefix`` items as map(label -> prefixes)."""
    parts = F.transform(raw, lambda item: F.filter(F.split(item, ","), lambda p: p != ""))
    items = F.transform(
        F.filter(parts, lambda p: F.size(p) > 0),
        lambda p, i: F.struct(
            p[0].alias("label"),
            F.array_distinct(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0)))).alias("prefixes"),
            i.alias("position"),
        ),
    )
    # a repeated label keeps its last item
    last = F.filter(
        items,
        lambda e: ~F.exists(items, lambda o: (o["label"] == e["label"]) & (o["position"] > e["position"])),
    )
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["label"], e["prefixes"])))
