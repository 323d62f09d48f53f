import math

import numpy as np
import pytest
from samples import CLASHES

from relaygrid.llm.common import read
from relaygrid.llm.eigen import leading_pairs
from relaygrid.llm.whitening import whiten

KIND = "vec_id long, embedding array<float>, " + ", ".join(f"`{c}` string" for c in CLASHES)


def vectors(spark, data):
    return spark.createDataFrame([(*r, *[f"{c}!" for c in CLASHES]) for r in data], KIND)


def plain(data, components=16):
    """(id, component) -> (n, deviation, size of the coordinate, explained), by numpy's own solver and exact integers."""
    x = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in data]
    fit = sorted({tuple(v) for _, v in x})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    c = np.array([[(n * a - s) / n for a, s in zip(v, sums, strict=True)] for v in fit])
    cov = c.T @ c / n
    values, basis = np.linalg.eigh(cov)
    values, basis = values[::-1], basis[:, ::-1]
    rows = []
    for i, v in x:
        d = [n * a - s for a, s in zip(v, sums, strict=True)]
        for k in range(min(components, len(values))):
            if values[k] > 1e-12 * values.sum():
                w = abs(np.array(d) / n @ basis[:, k]) / math.sqrt(values[k])
                rows.append((i, k + 1, n, sum(a * a for a in d), w, values[k] / values.sum()))
    return rows


def check(found, expected):
    found = sorted(found, key=lambda r: (repr(r["vec_id"]), r["component"], abs(r["whitened"])))
    expected = sorted(expected, key=lambda r: (repr(r[0]), r[1], r[4]))
    assert [(r["vec_id"], r["component"], r["n"], r["deviation"]) for r in found] == [r[:4] for r in expected]
    assert np.allclose([abs(r["whitened"]) for r in found], [r[4] for r in expected], atol=1e-7)
    assert np.allclose([r["explained"] for r in found], [r[5] for r in expected], rtol=1e-6)
    assert {r["identity_error"] for r in found} and max(r["identity_error"] for r in found) < 1e-8


@pytest.mark.parametrize("kind", ["random", "equal", "diagonal", "ones", "close", "low rank", "zero"])
@pytest.mark.parametrize("size", [1, 2, 7, 64])
def test_pairs(kind, size):
    draw = np.random.default_rng(size)
    a = draw.standard_normal((size, size))
    q, _ = np.linalg.qr(a)
    b = a[: max(1, size // 3)]
    matrix = {
        "random": a @ a.T, "equal": np.eye(size), "diagonal": np.diag(draw.random(size)), "ones": np.ones((size, size)), "zero": a * 0,
        "close": q @ np.diag(np.repeat([1, 1 + 1e-9, 0.5], size)[:size]) @ q.T, "low rank": b.T @ b * 1e12,
    }[kind]
    matrix = (matrix + matrix.T) / 2
    values, x = leading_pairs(matrix, 16)
    scale = max(np.abs(matrix).max(), 1e-300) * size
    assert np.abs(values - np.sort(np.linalg.eigvalsh(matrix))[::-1][: len(values)]).max() / scale < 1e-12
    assert np.abs(x @ x.T - np.eye(len(x))).max() < 1e-12
    assert np.abs(x @ matrix - values[:, None] * x).max() / scale < 1e-12


def test_query_against_numpy(spark):
    rows = read(spark, "/root/testdata/sf0.01", "embeddings")
    data = [(r["vec_id"], r["embedding"]) for r in rows.collect()]
    check(whiten(rows).collect(), plain(data))


def test_odd_rows(spark):
    draw = np.random.default_rng(3)
    sound = [(i, draw.normal(0, 2, 5).astype("float32").tolist()) for i in range(40)]
    sound += [(7, sound[7][1]), (None, sound[3][1]), (50, sound[8][1])] + [(100 + i, sound[0][1]) for i in range(60)]
    odd = [(60, None), (61, []), (62, [1.0, None, 1.0, 1.0, 1.0]), (63, [1.0, float("nan"), 1.0, 1.0, 1.0]), (64, [float("inf")] * 5), (65, [1.0] * 4)]
    found = whiten(vectors(spark, sound + odd).repartition(7)).collect()
    check(found, plain(sound))


def test_fewer_directions_and_empty_tables(spark):
    flat = [(i, [float(i), 2.0 * i, 5.0]) for i in range(10)]
    found = whiten(vectors(spark, flat)).collect()
    check(found, plain(flat))
    assert {r["component"] for r in found} == {1}
    assert whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    assert whiten(vectors(spark, [])).count() == 0
    assert whiten(vectors(spark, [(1, None)])).count() == 0


def test_large_entries_stay_exact(spark):
    data = [(i, [float(i % 3) * 2.0**40, float(i), -1.0]) for i in range(6)]
    found = whiten(vectors(spark, data)).collect()
    exact = plain(data)
    expected = {(r[0], r[1]): r[3] if r[3] < 2**63 else None for r in exact}
    assert {(r["vec_id"], r["component"]): r["deviation"] for r in found if r["component"] == 1} == {k: v for k, v in expected.items() if k[1] == 1}
