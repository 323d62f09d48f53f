"""Embedding whitening: project on the leading components of the centred covariance, each scaled to variance one.

Counts, sums and the centred covariance are added up in the tasks (one partial
result a task, of the vectors' dimension, not of their number) and combined by
a shuffle on the matrix' cells.  The driver sees the d x d matrix only, finds
its leading eigenpairs (:mod:`relaygrid.llm.eigen`) and sends the projection,
at most ``components`` rows of d numbers, to the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relaygrid.llm.eigen import leading_pairs
from relaygrid.session import settle

#: Entries become integers: floor(STEPS * c) + SHIFT.
STEPS, SHIFT = 64, 1_000_000
#: Components whose variance is below this share of the total are rounding, not directions.
LEAST_SHARE = 1e-12
#: Larger entries are cut to this size, so that the integers stay in range.
MOST = 2.0**61


def usable(vector: Column) -> Column:
    """Not null, and every entry a finite number."""
    sound = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.coalesce(vector.isNotNull() & sound, F.lit(False))


def grid(vectors: pa.Array) -> np.ndarray:
    """Vectors of one length as a matrix of integers."""
    entries = np.asarray(vectors.flatten().cast(pa.float64()))
    steps = np.clip(np.floor(STEPS * entries), -MOST, MOST).astype(np.int64)
    return (steps + SHIFT).reshape(len(vectors), -1)


def packed(x: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in x], type=pa.binary())


def unpacked(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<i8").reshape(len(column), -1)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exactly: as long integers, or as Python's where these are too short."""
    largest = max((abs(int(x.min())), abs(int(x.max())))) if x.size else 0
    if n * largest < 2**62:
        return n * x - np.array(sums, dtype=np.int64)
    return n * x.astype(object) - np.array(sums, dtype=object)


def squares(d: np.ndarray) -> list[int | None]:
    """Sum of squares of each row; null where it does not fit a long."""
    largest = int(np.abs(d).max()) if d.size else 0
    if d.dtype != object and d.shape[1] * largest**2 < 2**63:
        return (d * d).sum(axis=1).tolist()
    exact = (d.astype(object) ** 2).sum(axis=1).tolist()
    return [int(v) if v < 2**63 else None for v in exact]


def centred(d: np.ndarray, n: int) -> np.ndarray:
    return d.astype(float) / n


def _cells(rows: DataFrame, fold, kind: str) -> DataFrame:
    """Sums over all rows of ``fold(batch)``, a flat array, as (pos, value): one partial array a task."""
    number = pa.int64() if kind == "long" else pa.float64()

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = fold(unpacked(batch.column(0))).ravel()
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total], type=pa.list_(number))], ["cells"])

    cells = rows.mapInArrow(partial, f"cells array<{kind}>").select(F.posexplode("cells").alias("pos", "value"))
    wide = "decimal(38,0)" if kind == "long" else kind
    return cells.groupBy("pos").agg(F.sum(F.col("value").cast(wide)).alias("value"))


def _collected(cells: DataFrame) -> list:
    """The cells in order; as many as the dimension or its square."""
    return [r["value"] for r in sorted(cells.collect(), key=lambda r: r["pos"])]


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 16) -> DataFrame:
    """Whitened coordinates of every vector: one row per vector and component.

    Columns: ``id_col``, component (from 1, by falling variance), n, deviation,
    whitened, explained, identity_error.  The fit uses each distinct integer
    vector once; every row is projected.

    * Vectors that are null or hold null or non-finite entries are left out, and
      so are vectors of another length than the commonest (the longer of two).
    * Repeated ids and repeated vectors each give their own rows; a null id is kept.
    * Directions without variance have no component, so fewer than ``components``
      may come out: none for one distinct vector or an empty table.
    * ``deviation`` is null where the exact sum does not fit a long.
    """
    spark = rows.sparkSession
    kind = rows.schema[id_col].dataType.simpleString()
    given = rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where(usable(F.col("vector")))
    out = f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    lengths = given.groupBy(F.size("vector").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).limit(1).collect()
    if not lengths or not lengths[0]["length"]:
        return spark.createDataFrame([], out)
    size = lengths[0]["length"]
    given = given.where(F.size("vector") == size)

    def to_grid(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([packed(grid(batch.column(0)))], ["x"])

    fit = settle(given.select("vector").mapInArrow(to_grid, "x binary").distinct(), "whitening-fit")
    n = fit.count()
    # halves of the numbers are added up, so that no task's sum leaves the range of a long
    halves = _collected(_cells(fit, lambda x: np.concatenate([(x >> 32).sum(axis=0), (x & (2**32 - 1)).sum(axis=0)]), "long"))
    sums = [int(high) * 2**32 + int(low) for high, low in zip(halves[:size], halves[size:], strict=True)]

    def products(x):
        c = centred(deviations(x, n, sums), n)
        return c.T @ c

    covariance = np.array(_collected(_cells(fit, products, "double"))).reshape(size, size) / n
    covariance = (covariance + covariance.T) / 2
    values, vectors = leading_pairs(covariance, components)
    trace = float(np.trace(covariance))
    many = int((values > LEAST_SHARE * trace).sum()) if trace > 0 else 0
    if not many:
        return spark.createDataFrame([], out)
    projection = (vectors[:many] / np.sqrt(values[:many])[:, None]).T
    explained = values[:many] / trace

    def whitened_products(x):
        y = centred(deviations(x, n, sums), n) @ projection
        return y.T @ y

    spread = np.array(_collected(_cells(fit, whitened_products, "double"))).reshape(many, many) / n
    error = float(np.abs(spread - np.eye(many)).max())

    def project(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            d = deviations(grid(batch.column("vector")), n, sums)
            y = centred(d, n) @ projection
            times = np.repeat(np.arange(batch.num_rows), many)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(pa.array(times)),
                    pa.array(np.tile(np.arange(1, many + 1, dtype=np.int32), batch.num_rows)),
                    pa.array(np.full(len(times), n, dtype=np.int64)),
                    pa.array(squares(d), type=pa.int64()).take(pa.array(times)),
                    pa.array(y.ravel()), pa.array(np.tile(explained, batch.num_rows)), pa.array(np.full(len(times), error)),
                ],
                [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return given.select("id", "vector").mapInArrow(project, out)
