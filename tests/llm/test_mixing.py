import re

import pytest
from pyspark.sql import functions as F
from samples import docs, empty, prose, rows

from relaygrid.llm.mixing import mix, mixed_texts, shard_counts, shard_rows, slot_of_block, targets

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain_targets(sizes):
    """Share, stop what is above its cap, share the excess anew, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= over
    return out


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 1000, "c": 1000, None: 5}, {"b": 7}, {"x": 0, "y": 10}, {"x": 0}, {chr(97 + i): (i * 37) % 91 for i in range(20)}])
def test_targets(spark, sizes):
    found = {r["source"]: r["target"] for r in targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    assert found == pytest.approx(plain_targets(sizes))


@pytest.mark.parametrize("blocks", [1, 2, 7, 64, 1000])
def test_order_of_blocks_is_a_permutation(spark, blocks):
    df = spark.range(blocks).select(slot_of_block(F.col("id"), F.lit(blocks).cast("long"), F.lit(99)).alias("slot"))
    assert sorted(r["slot"] for r in df.collect()) == list(range(blocks))


def test_mix_of_odd_rows(spark):
    data = rows() + [(100 + i, prose(i, 40 + i), "en", "abcz"[i % 4]) for i in range(60)]
    df = docs(spark, data)
    found = mix(df).collect()
    assert sorted([(r["doc_id"], r["size"]) for r in found], key=repr) == sorted([(i, len(WORD.findall(t or ""))) for i, t, *_ in data], key=repr)
    sizes, taken = {}, {}
    for r in found:
        here = sum(s["words"] for s in r["spans"])
        assert here <= 2 * r["size"]
        assert all(0 <= s["start"] and s["start"] + s["words"] <= r["size"] for s in r["spans"])
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + here
    wanted = plain_targets(sizes)
    assert {r["source"]: r["target"] for r in found} == pytest.approx(wanted)
    for source, target in wanted.items():
        assert abs(taken[source] - target) <= 64
    again = mix(df.repartition(5)).collect()
    assert sorted(map(repr, found)) == sorted(map(repr, again))
    # each slot is one block, read from its first word to its last
    slots = {}
    for r in shard_rows(mix(df)).collect():
        slots.setdefault((r["source"], r["slot"]), []).append((r["shard"], r["block"], r["words"]))
    for parts in slots.values():
        assert len({p[:2] for p in parts}) == 1 and sum(p[2] for p in parts) <= 64
    assert sum(r["slots"] for r in shard_counts(mix(df)).collect()) == len(slots)


def test_texts_of_the_mix(spark):
    data = rows() + [(200 + i, prose(i, 90), "en", "abcd"[i % 4]) for i in range(40)]
    df = docs(spark, data)
    out = mixed_texts(df)
    assert out.columns == df.columns
    taken = mix(df).select(F.coalesce(F.sum(F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["words"])), F.lit(0))).first()[0]
    texts = [r["text"] for r in out.collect()]
    assert sum(len(WORD.findall(t or "")) for t in texts) == taken
    assert None in texts and "" in texts
    whole = {t for _, t, *_ in data}
    assert sum(t in whole for t in texts) > 20


def test_empty(spark):
    assert mix(empty(spark)).count() == 0
    assert mixed_texts(empty(spark)).count() == 0
