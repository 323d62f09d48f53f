import random

import pytest
from brute import near_groups
from pyspark.sql import functions as F
from samples import docs, empty, prose, rows

from relaygrid.llm.components import components
from relaygrid.llm.near_dedup import drop_near_copies, near_dedup


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(1, 1), (2, 3), (3, 2), (3, 4)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 40)], [(None, 1), (9, 8), (7, 9)]])
def test_components(spark, edges):
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    assert found == {x: find(x) for x in root if find(x) != x}


def edited(text: str, changes: int, seed: int) -> str:
    draw, words = random.Random(seed), text.split()
    for _ in range(changes):
        words[draw.randrange(len(words))] = f"new{draw.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("size", [2, 5])
def test_families_like_brute_force(spark, size):
    """Families whose members are linked through some member only, and members that just miss the threshold."""
    data = []
    for family in range(6):
        base = prose(family, 120)
        data += [(1000 * family + i, edited(base, i % 17, 100 * family + i), "en", "a") for i in range(60, 0, -1)]
    data += [(9000 + i, prose(500 + i, 30), "en", "b") for i in range(50)]
    want = near_groups([(i, t) for i, t, *_ in data], size)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup(docs(spark, data), size=size).collect()}
    assert found == {i: (n, c, c == i) for i, (n, c) in want.items()}
    assert len({c for _, c in want.values()}) < len(data)


def test_odd_rows(spark):
    found = sorted([tuple(r) for r in near_dedup(docs(spark), size=2).collect()], key=repr)
    unique = {i: t for i, t, *_ in rows() if i is not None}
    want = near_groups(list(unique.items()), 2)
    assert [f for f in found if f[0] is not None] == sorted([(i, *want[i], want[i][1] == i) for i, *_ in rows() if i is not None], key=repr)
    # without an id: the component of an equal set, or none
    assert sorted([f[2:] for f in found if f[0] is None], key=repr) == [(1, False), (None, True)]
    assert {f[1] for f in found if f[0] in (8, 9)} == {1} and want[9][1] == 8 and want[2][1] == 2 and want[3][1] == 3


def test_rows_that_share_an_id_join_their_groups(spark):
    one, two = prose(1, 50), prose(2, 50)
    data = [(1, one, "en", "a"), (2, two, "en", "a"), (3, one, "en", "a"), (3, two, "en", "a")]
    assert {r["component_id"] for r in near_dedup(docs(spark, data)).collect()} == {1}


def test_stage(spark):
    stay = drop_near_copies(docs(spark), size=2)
    assert stay.columns == docs(spark).columns
    ids = [r["doc_id"] for r in stay.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == [1, 2, 3, 4, 5, 8, 10, 11, 13] and ids.count(None) == 2
    assert drop_near_copies(empty(spark)).count() == 0 and near_dedup(empty(spark)).count() == 0


def test_one_large_group(spark):
    base = prose(3, 80)
    data = [(i, edited(base, 1 + i % 12, i), "en", "a") for i in range(400)]
    want = near_groups([(i, t) for i, t, *_ in data], 2)
    found = {r["doc_id"]: r["component_id"] for r in near_dedup(docs(spark, data).repartition(3, F.col("doc_id")), size=2).collect()}
    assert found == {i: c for i, (_, c) in want.items()}
