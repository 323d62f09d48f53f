import numpy as np
import pytest
from pyspark.sql import functions as F

from relaygrid.llm import ann, partitions

KIND = "vec_id long, embedding array<float>, id string, vector string, part string, label int"


def brute(data, k, query):
    usable = [(i, np.array(v, float)) for i, v in data if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v) and len(v) == 3]
    out = []
    for q, x in {i: v for i, v in usable}.items():
        if query(q):
            best = {}
            for j, y in usable:
                if j != q:
                    best[j] = max(best.get(j, -np.inf), float((y * x).sum()))
            ranked = sorted(best.items(), key=lambda p: (-p[1], p[0]))[:k]
            out += [(q, n + 1, j, s) for n, (j, s) in enumerate(ranked)]
    return sorted(out)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    data = [(i, [np.float32(np.sin(i)), np.float32(np.cos(3 * i)), np.float32(i % 5)]) for i in range(50)]
    data = [(i, [float(x) for x in v]) for i, v in data]
    data += [(100, None), (101, []), (102, [0.0, 0.0, 0.0]), (103, [1.0, None, 1.0]), (104, [nan, 1.0, 1.0]), (105, [inf, 1.0, 1.0]), (106, [1.0, 2.0]), (None, [1.0, 1.0, 1.0])]
    data += [(200 + i, [0.5, 0.5, 0.5]) for i in range(30)] + [(7, data[7][1])]
    df = spark.createDataFrame([(*r, "x", "y", "z", 1) for r in data], KIND)
    found = sorted(tuple(r) for r in ann.nearest(df, F.col("vec_id") % 10 == 0, k=20).collect())
    want = brute(data, 20, lambda q: q % 10 == 0)
    assert [f[:3] for f in found] == [w[:3] for w in want]
    assert [f[3] for f in found] == pytest.approx([w[3] for w in want], abs=1e-12)


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], "", "", "", 1), (1, [0.5, 0.5], "", "", "", 1)], KIND)
    assert [tuple(r) for r in ann.nearest(df, F.col("vec_id") % 20 == 0).collect()] == [(0, 1, 1, 0.5)]
    assert ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.nearest(df.limit(1), F.col("vec_id") % 20 == 0).count() == 0


def test_parts_are_balanced_and_keep_neighbours():
    draw = np.random.default_rng(1)
    x = (np.repeat(draw.normal(size=(8, 16)), 100, axis=0) * 3 + draw.normal(size=(800, 16))).astype(np.float32)
    graph = partitions.neighbour_graph(x)
    part = partitions.balanced_parts(graph, 3)
    assert set(np.bincount(part)) == {100}
    assert (part[graph] == part[:, None]).mean() > 0.8
    router = partitions.Router.train(x, part, 8)
    assert (router.scores(x).argmax(axis=1) == part).mean() > 0.9


def test_recall_and_hot_vectors(spark):
    """Recall of the learned parts against brute force, with a third of the rows one vector."""
    draw = np.random.default_rng(2)
    x = draw.normal(size=(6000, 16)) + np.repeat(draw.normal(size=(20, 16)) * 2, 300, axis=0)
    x[::3] = x[0]
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in row], "", "", "", 1) for i, row in enumerate(x)], KIND).repartition(4)
    rows, dimension = ann.clean(df, "vec_id", "embedding")
    parts = ann.learn(rows, dimension)
    assert parts.parts > 1 and parts.probes < parts.parts
    found = ann.nearest(df, F.col("vec_id") % 20 == 0).collect()
    wide = x.astype(float)
    hit = total = 0
    got = {}
    for r in found:
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert len(got) == 300 and all(len(v) == 20 for v in got.values())
    for q, rows_ in got.items():
        score = wide @ wide[q]
        score[q] = -9
        least = np.sort(score)[-20] - 1e-9
        ranked = sorted(rows_)
        assert ranked == sorted(rows_, key=lambda r: (-r[2], r[1])) and [r[0] for r in ranked] == list(range(1, 21))
        assert all(abs(score[v] - s) < 1e-9 for _, v, s in ranked)
        hit += sum(s >= least for _, _, s in ranked)
        total += 20
    assert hit / total >= 0.9
