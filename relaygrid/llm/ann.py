"""Approximate nearest neighbours by learned partitions.

:func:`learn` cuts the neighbour graph of a bounded sample into balanced parts
(:mod:`relaygrid.llm.partitions`), trains a small classifier, and finds how
many parts a query must visit for the wanted recall.  :func:`index` gives every
row its most probable part.  :func:`search` sends each query to its most
probable parts, where it meets the part's rows in blocks of bounded size, and
reranks by the exact inner product in double precision.

A query meets the sample on its way.  Its nearest rows there are part of what
it finds and bound the result from below: a block only reports rows that reach
that bound, at most as many as the result holds.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from relaygrid.llm.partitions import Router, balanced_parts, neighbour_graph
from relaygrid.session import settle

#: Rows that teach the parts, rows per part aimed at (parts are powers of two), and recall aimed at on rows kept from training.
SAMPLE, PART_ROWS, MOST_LEVELS, RECALL = 8192, 512, 7, 0.94
#: Rows and queries that meet in one group.
BLOCK, QUERIES = 4096, 1024


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    """The vectors of an Arrow column of lists, all of one length, in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(-1, dimension)


def usable(vector: Column) -> Column:
    """Neither null nor zero, and without null or non-finite components."""
    value = lambda x: x.cast("double")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(value(x)) & (F.abs(value(x)) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


@dataclass(frozen=True)
class Parts:
    """What :func:`learn` found: the router, how many parts a query visits, and the sample (for lower bounds)."""

    dimension: int
    parts: int
    probes: int
    router: Router | None
    ids: np.ndarray
    sample: np.ndarray

    def ranked(self, x: np.ndarray) -> np.ndarray:
        """The ``probes`` most probable parts of each vector, the most probable first."""
        if self.router is None:
            return np.zeros((len(x), 1), np.int32)
        scores = self.router.scores(x.astype(np.float32))
        return np.argsort(-scores, axis=1, kind="stable")[:, : self.probes].astype(np.int32)

    def in_sample(self, ids: np.ndarray, x: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """The k nearest other rows of the sample for each vector: (ids, inner products), the k-th last; fewer if there are fewer."""
        found = []
        for start in range(0, len(x), 512):
            near = x[start : start + 512] @ self.sample.T
            near[ids[start : start + 512, None] == self.ids[None]] = -np.inf
            for n, row in enumerate(near):
                rows = np.argpartition(-row, k - 1)[:k] if len(row) > k else np.arange(len(row))
                rows = rows[row[rows] > -np.inf]
                score = (self.sample[rows] * x[start + n]).sum(axis=1)
                order = np.argsort(-score, kind="stable")
                found.append((self.ids[rows][order], score[order]))
        return found


def clean(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(id, vector) of the usable rows of the commonest length, and that length."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")).where(F.col("id").isNotNull() & usable(F.col("vector")))
    sizes = rows.groupBy(F.size("vector").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "size").limit(1).collect()
    dimension = sizes[0]["size"] if sizes else 0
    return rows.where(F.size("vector") == dimension), dimension


def learn(rows: DataFrame, dimension: int, k: int = 20, sample: int = SAMPLE, recall: float = RECALL) -> Parts:
    """Fit on about ``sample`` rows, drawn by a hash of the id, however many there are."""
    total = rows.count()
    chance = int(min(1.0, sample / max(1, total)) * (1 << 30))
    drawn = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < chance).limit(2 * sample).toArrow()
    ids, x = np.asarray(drawn["id"], np.int64), _matrix(drawn["vector"], dimension) if drawn.num_rows else np.empty((0, dimension))
    # in order of id, each id once
    ids, order = np.unique(ids, return_index=True)
    x = x[order]
    levels = min(MOST_LEVELS, int(np.log2(max(1, total / PART_ROWS))))
    if not levels or len(x) < 48 * 2**levels:
        return Parts(dimension, 1, 1, None, ids, x)
    teach = np.arange(len(x)) % 4 != 3
    small = x[teach].astype(np.float32)
    part = balanced_parts(neighbour_graph(small), levels)
    router = Router.train(small, part, 2**levels)
    # rows kept from training ask for each other: how many parts until the wanted share is found?
    kept = x[~teach]
    scores = router.scores(kept.astype(np.float32))
    place = np.argsort(np.argsort(-scores, axis=1, kind="stable"), axis=1)
    # as deep among the kept rows as the result is among all
    near = neighbour_graph(kept, max(1, round(k * len(kept) / total)))
    rank = np.take_along_axis(place, scores.argmax(axis=1)[near], axis=1)
    probes = next(m for m in range(1, 2**levels + 1) if (rank < m).mean() >= recall)
    return Parts(dimension, 2**levels, probes, router, ids, x)


def index(rows: DataFrame, parts: Parts) -> DataFrame:
    """id, vector, part of every row, in the shared folder."""

    @F.arrow_udf(T.IntegerType())
    def route(vector: pa.Array) -> pa.Array:
        return pa.array(parts.ranked(_matrix(vector, parts.dimension))[:, 0] if len(vector) else [], pa.int32())

    return settle(rows.select("id", "vector", route("vector").alias("part")), "ann-index")


def search(indexed: DataFrame, parts: Parts, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each query (id, vector), nearest first, ties to the smaller id."""
    hit = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])
    kind = T.StructType([
        T.StructField("bound", T.DoubleType()), T.StructField("parts", T.ArrayType(T.IntegerType())), T.StructField("hits", T.ArrayType(hit)),
    ])

    @F.arrow_udf(kind)
    def route(ids: pa.Array, vector: pa.Array) -> pa.Array:
        x = _matrix(vector, parts.dimension)
        seen = parts.in_sample(np.asarray(ids), x, k)
        bounds = [float(score[-1]) - 1e-9 if len(score) == k else -np.inf for _, score in seen]
        hits = pa.StructArray.from_arrays([
            pa.array(np.concatenate([i for i, _ in seen]) if seen else [], pa.int64()),
            pa.array(np.concatenate([score for _, score in seen]) if seen else [], pa.float64()),
        ], ["vec_id", "score"])
        ends = np.cumsum([0, *[len(i) for i, _ in seen]])
        return pa.StructArray.from_arrays([
            pa.array(bounds, pa.float64()), pa.array(list(parts.ranked(x)), pa.list_(pa.int32())),
            pa.ListArray.from_arrays(pa.array(ends, pa.int32()), hits),
        ], ["bound", "parts", "hits"])

    routed = settle(queries.select("id", "vector", route("id", "vector").alias("way")).select("id", "vector", "way.*"), "ann-routed")
    visits = routed.select("id", "vector", "bound", F.explode("parts").alias("part"))
    # two rows a part: how many blocks of rows, and of queries
    blocks = indexed.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    asked = visits.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("rounds"))
    sizes = F.broadcast(settle(blocks.join(asked, "part"), "ann-sizes"))  # at most 2 ** MOST_LEVELS rows
    keys = ["part", "block", "round"]

    def dealt(df: DataFrame, own: str, count: str, other: str, others: str) -> DataFrame:
        placed = df.join(sizes, "part").withColumn(own, F.pmod(F.xxhash64("id"), F.col(count)).cast("int"))
        return placed.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(others) - 1)))

    left = dealt(indexed, "block", "blocks", "round", "rounds").select(*keys, "id", "vector")
    right = dealt(visits, "round", "rounds", "block", "blocks").select(*keys, "id", "vector", "bound")
    found_kind = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def meet(base: pa.Table, asking: pa.Table) -> pa.Table:
        if not base.num_rows or not asking.num_rows:
            return schema.empty_table()
        ids, x = np.asarray(base["id"]), _matrix(base["vector"], parts.dimension)
        who, q, bounds = np.asarray(asking["id"]), _matrix(asking["vector"], parts.dimension), np.asarray(asking["bound"])
        distinct = np.unique(ids)
        order = np.argsort(ids, kind="stable")
        starts = np.searchsorted(ids[order], distinct)
        out = []
        for start in range(0, len(q), 128):
            near = q[start : start + 128] @ x.T
            near[who[start : start + 128, None] == ids[None]] = -np.inf
            least = bounds[start : start + 128]
            if len(distinct) > k:
                each = near if len(distinct) == len(ids) else np.maximum.reduceat(near[:, order], starts, axis=1)
                # products of a block may differ in the last bit: a margin keeps ties together
                least = np.maximum(least, np.partition(each, -k, axis=1)[:, -k] - 1e-9)
            for n in range(len(near)):
                rows = np.flatnonzero((near[n] >= least[n]) & (near[n] > -np.inf))
                score = (x[rows] * q[start + n]).sum(axis=1)
                best = np.lexsort((ids[rows], -score))
                best = best[np.sort(np.unique(ids[rows][best], return_index=True)[1])][:k]
                out.append((np.full(len(best), who[start + n]), ids[rows][best], score[best]))
        return pa.table([np.concatenate([o[c] for o in out]) for c in range(3)], schema=schema)

    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, found_kind)
    # the sample's rows were met on the way
    early = routed.select(F.col("id").alias("query_id"), F.explode("hits").alias("hit")).select("query_id", "hit.vec_id", "hit.score")
    once = found.unionByName(early).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = once.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20) -> DataFrame:
    """The ``k`` nearest rows of each row of ``vectors`` that ``is_query`` picks, its own excepted.

    * Vectors that are null, zero or hold null or non-finite components take no
      part, nor do rows without an id or of another length than the commonest.
    * Rows that repeat an id count as one vector, as near as its nearest row.
    * Fewer than ``k`` other vectors: all that were found; an empty table gives
      an empty result; other columns take no part.
    """
    rows, dimension = clean(vectors, id_col, vector_col)
    rows = rows.withColumn("id", F.col("id").cast("long"))
    parts = learn(rows, dimension, k)
    queries = vectors.where(is_query).select(F.col(id_col).alias("id")).distinct()
    indexed = index(rows, parts)
    return search(indexed, parts, indexed.select("id", "vector").join(queries, "id", "left_semi"), k)
