"""The blob catalog: bytes addressed by (source, label, sha256)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relaygrid.functions import content as C
from relaygrid.operators.filters import instant

KEY = ["source", "label", "sha256"]


def judge_uploads(uploads: DataFrame, minimal: bool = False) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) of ``uploads``, with what describes their bytes.

    Columns in: ``source, label, data`` and optionally ``expected_sha256``,
    ``skip_identify``, ``upload_id``.  Empty bytes, a wrong expected hash and a
    skipped identification without an expected hash are rejected.
    """
    expected = F.col("expected_sha256") if "expected_sha256" in uploads.columns else F.lit(None).cast("string")
    skip = F.col("skip_identify") if "skip_identify" in uploads.columns else F.lit(False)
    described = uploads.select("*", *C.content_hashes(F.col("data"), minimal))
    blank = F.coalesce(expected, F.lit("")) == ""
    error = (
        F.when(F.coalesce(skip, F.lit(False)) & blank, "must supply sha256 when skipping identify")
        .when(F.coalesce(F.octet_length("data"), F.lit(0)) == 0, "no content")
        .when(~blank & (expected != F.col("sha256")), "sha256 mismatch")
    )
    judged = described.withColumn("error", error)
    return judged.where(F.col("error").isNull()).drop("error"), judged.where(F.col("error").isNotNull())


def ingest_blobs(uploads: DataFrame, minimal: bool = False) -> tuple[DataFrame, DataFrame]:
    """(catalog rows with their bytes, rejected uploads); :mod:`blob_store` keeps bytes apart."""
    good, refused = judge_uploads(uploads, minimal)
    return good.dropDuplicates(KEY), refused


def blob_lookup(requests: DataFrame, catalog: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Resolve requests: the exact address first, then the unprefixed one.

    Adds ``found``, ``found_source``, ``found_label`` and the ``extra`` columns.
    The catalog has one row per address, so neither join multiplies rows.
    """
    extra = extra or []
    exact = catalog.select(*KEY, F.struct(F.lit(True).alias("hit"), *extra).alias("_exact"))
    bare = catalog.where((F.col("source") == "") & (F.col("label") == "")).select(
        "sha256", F.struct(F.lit(True).alias("hit"), *extra).alias("_bare")
    )
    joined = requests.join(exact, KEY, "left").join(bare, "sha256", "left")
    is_exact = F.col("_exact").isNotNull()
    chosen = F.coalesce(F.col("_exact"), F.col("_bare"))
    return joined.select(
        *requests.columns, chosen.isNotNull().alias("found"),
        F.when(is_exact, F.col("source")).when(F.col("_bare").isNotNull(), "").alias("found_source"),
        F.when(is_exact, F.col("label")).when(F.col("_bare").isNotNull(), "").alias("found_label"),
        *[chosen[c].alias(c) for c in extra],
    )


def read_ranges(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """Serve byte-range requests (column ``range``) from a catalog with ``data``.

    Requests find their blob by its address alone; only what is found, and asks
    for a range that parses, meets the bytes.
    """
    parsed = requests.withColumn("_range", C.parse_byte_range(F.col("range")))
    found = blob_lookup(parsed, catalog)
    bytes_of = catalog.select(
        F.col("source").alias("found_source"), F.col("label").alias("found_label"), F.col("sha256"), "data"
    )
    usable = F.col("_range.error").isNull()
    wanted = found.withColumn("found_source", F.when(usable, F.col("found_source")))
    served = wanted.join(bytes_of, ["found_source", "found_label", "sha256"], "left")
    part = C.slice_bytes(F.col("data"), F.col("_range.start"), F.col("_range.length"))
    return served.select(
        *requests.columns, "found", F.col("_range.error").alias("error"),
        F.when(F.col("_range.error").isNull(), part).alias("part"),
    )


def blob_copy(requests: DataFrame, catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new catalog, report) after copying between sources.

    Requests: ``source_from, source_to, label, sha256``.  Copies within one
    source and copies of missing blobs change nothing.
    """
    asked = requests.withColumnRenamed("source_from", "source")
    payload = [c for c in catalog.columns if c not in KEY]
    resolved = blob_lookup(asked, catalog, payload)
    outcome = (
        F.when(F.col("source") == F.col("source_to"), "skipped").when(F.col("found"), "copied").otherwise("not found")
    )
    report = resolved.withColumn("outcome", outcome)
    fresh = (
        report.where(F.col("outcome") == "copied")
        .select(F.col("source_to").alias("source"), "label", "sha256", *payload)
        .dropDuplicates(KEY)
    )
    added = fresh.join(catalog.select(*KEY), KEY, "left_anti").select(*catalog.columns)
    return catalog.unionByName(added), report.select(*asked.columns, "outcome").withColumnRenamed("source", "source_from")


def blob_delete(requests: DataFrame, catalog: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """(remaining catalog, report): delete what resolves and is old enough.

    Requests: the address and ``if_older_than`` seconds; the catalog carries
    ``stored_at``.
    """
    resolved = blob_lookup(requests, catalog, ["stored_at"])
    age_s = (F.unix_micros(instant(now)) - F.unix_micros("stored_at")) / 1_000_000
    old_enough: Column = age_s >= F.coalesce(F.col("if_older_than"), F.lit(0))
    outcome = F.when(~F.col("found"), "not found").when(old_enough, "deleted").otherwise("kept")
    report = resolved.withColumn("outcome", outcome)
    gone = report.where(F.col("outcome") == "deleted").select(
        F.col("found_source").alias("source"), F.col("found_label").alias("label"), "sha256"
    ).distinct()
    return catalog.join(gone, KEY, "left_anti"), report.drop("stored_at")
