"""Blobs by content: bytes once per sha256, in chunks; addresses are references to them.

``refs`` has one row per address (source, label, sha256) with ``size`` and
``stored_at``; ``chunks`` has (sha256, chunk, bytes).  Copying adds references
and deleting drops them; neither reads a byte.  Chunks go when the last
reference to their content does.  A range request meets the chunks its bytes
lie in, and no others.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relaygrid.functions import content as C
from relaygrid.operators import blobs
from relaygrid.operators.blobs import KEY
from relaygrid.session import settle

#: Bytes of a chunk.
CHUNK = 1 << 18


@dataclass(frozen=True)
class Store:
    refs: DataFrame
    chunks: DataFrame
    chunk_bytes: int = CHUNK


def empty(spark, chunk_bytes: int = CHUNK) -> Store:
    refs = spark.createDataFrame([], "source string, label string, sha256 string, size long, stored_at timestamp")
    return Store(refs, spark.createDataFrame([], "sha256 string, chunk int, bytes binary"), chunk_bytes)


def _cut(data: Column, size: Column, chunk_bytes: int) -> Column:
    """Array of (chunk, bytes); the last chunk may be shorter."""
    numbers = F.sequence(F.lit(0), F.floor((size - 1) / chunk_bytes).cast("int"))
    return F.transform(numbers, lambda n: F.struct(n.alias("chunk"), F.substring(data, n * chunk_bytes + 1, F.lit(chunk_bytes)).alias("bytes")))


def ingest(store: Store, uploads: DataFrame, stored_at, row_id: str = "upload_id") -> tuple[Store, DataFrame]:
    """(store, rejected uploads) after :func:`blobs.ingest_blobs`' judgement of ``uploads``.

    Hashes and verdicts are settled without the bytes.  One upload brings the
    bytes of a content that the store does not hold; the others are left out by
    their ``row_id``, unique and not null, so bytes are neither grouped nor compared.
    """
    described, refused = blobs.judge_uploads(uploads, minimal=True)
    narrow = settle(described.select(row_id, *KEY, "size"), "uploads")
    held = store.refs.select("sha256").distinct()
    bringers = narrow.join(held, "sha256", "left_anti").groupBy("sha256").agg(F.min(row_id).alias("_first"))
    others = uploads.select(row_id).join(settle(bringers.select(F.col("_first").alias(row_id)), "bringers"), row_id, "left_anti")
    pieces = (
        uploads.select(row_id, "data").join(settle(others, "not-bringing"), row_id, "left_anti")
        .select(F.sha2("data", 256).alias("sha256"), F.explode(_cut(F.col("data"), F.octet_length("data"), store.chunk_bytes)).alias("c"))
        .select("sha256", "c.chunk", "c.bytes")
    )
    at = stored_at if isinstance(stored_at, Column) else F.lit(stored_at).cast("timestamp")
    fresh = narrow.select(*KEY, "size").distinct().join(store.refs.select(*KEY), KEY, "left_anti").withColumn("stored_at", at)
    refs = settle(store.refs.unionByName(fresh.select(*store.refs.columns)), "blob-refs")
    return Store(refs, store.chunks.unionByName(settle(pieces, "blob-chunks")), store.chunk_bytes), refused


def copy(store: Store, requests: DataFrame) -> tuple[Store, DataFrame]:
    """(store, report) after copying between sources (see :func:`blobs.blob_copy`): references only."""
    refs, report = blobs.blob_copy(requests, store.refs)
    return Store(settle(refs, "blob-refs"), store.chunks, store.chunk_bytes), report


def delete(store: Store, requests: DataFrame, now) -> tuple[Store, DataFrame]:
    """(store, report) after deleting addresses (see :func:`blobs.blob_delete`): references only; :func:`sweep` frees bytes."""
    refs, report = blobs.blob_delete(requests, store.refs, now)
    return Store(settle(refs, "blob-refs"), store.chunks, store.chunk_bytes), report


def unreferenced(store: Store) -> DataFrame:
    """Contents that no address names any more, from the keys of the chunks alone."""
    return store.chunks.where("chunk = 0").select("sha256").join(store.refs.select("sha256").distinct(), "sha256", "left_anti")


def sweep(store: Store) -> Store:
    """The store without the chunks of unreferenced contents."""
    gone = settle(unreferenced(store), "unreferenced")
    return Store(store.refs, store.chunks.join(gone, "sha256", "left_anti"), store.chunk_bytes)


def wanted_chunks(requests: DataFrame, store: Store, row_id: str) -> DataFrame:
    """Resolved requests with the span of bytes they read, and one row per chunk of it (none: a NULL chunk)."""
    parsed = requests.withColumn("_range", C.parse_byte_range(F.col("range")))
    found = blobs.blob_lookup(parsed, store.refs, ["size"])
    start, length, size = F.col("_range.start"), F.col("_range.length"), F.col("size")
    begin = F.when(start < 0, F.greatest(size + start, F.lit(0))).otherwise(start)
    stop = F.when(length < 0, size).otherwise(F.least(begin + length, size))
    spans = found.select(row_id, "sha256", "found", F.col("_range.error").alias("error"), begin.alias("begin"), stop.alias("stop"))
    numbers = F.sequence(F.floor(F.col("begin") / store.chunk_bytes).cast("int"), F.floor((F.col("stop") - 1) / store.chunk_bytes).cast("int"))
    reads = F.col("found") & F.col("error").isNull() & (F.col("stop") > F.col("begin"))
    return spans.select("*", F.explode_outer(F.when(reads, numbers)).alias("chunk"))


def read_ranges(requests: DataFrame, store: Store, row_id: str) -> DataFrame:
    """Serve byte-range requests (column ``range``; addressed as in :func:`blobs.blob_lookup`) from the chunks they touch.

    Columns: ``row_id`` (unique), found, error, part.  A range behind the end
    is empty; a blob that is not found, or a range that does not parse, has no part.
    """
    wanted = settle(wanted_chunks(requests, store, row_id), "wanted-chunks")
    size = store.chunk_bytes
    low = F.greatest(F.col("begin") - F.col("chunk") * F.lit(size), F.lit(0).cast("long"))
    high = F.least(F.col("stop") - F.col("chunk") * F.lit(size), F.lit(size).cast("long"))
    piece = F.substring(F.col("bytes"), (low + 1).cast("int"), (high - low).cast("int"))
    met = wanted.where("chunk IS NOT NULL").join(store.chunks, ["sha256", "chunk"]).select(row_id, F.struct("chunk", piece.alias("piece")).alias("p"))
    whole = met.groupBy(row_id).agg(F.array_sort(F.collect_list("p")).alias("ps")).select(
        row_id, F.aggregate("ps", F.lit(b""), lambda done, p: F.concat(done, p["piece"])).alias("_part"))
    asked = wanted.select(row_id, "found", "error").distinct()
    served = F.col("found") & F.col("error").isNull()
    return asked.join(whole, row_id, "left").select(row_id, "found", "error", F.when(served, F.coalesce("_part", F.lit(b""))).alias("part"))
