import hashlib
import random
import zlib

import numpy as np
import pytest
from oracle_llm import differences
from pyspark.sql import functions as F
from samples import docs, rows

from relaygrid.llm.common import remainder
from relaygrid.llm.merkle import build, check_tampered, missing, prove


def sha(text: bytes) -> str:
    return hashlib.sha256(text).hexdigest()


def leaf_of(row):
    parts = []
    for v in row:
        text = None if v is None else str(v).encode()
        parts.append(b"-" if text is None else str(len(text)).encode() + b":" + text)
    return sha(b"".join(parts))


def climb(nodes, fan):
    """Levels from the leaves to the root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha("".join(below[i : i + fan]).encode()) for i in range(0, len(below), fan)])
    return levels


def path(levels, place, value, fan):
    """(siblings, folded) from a place of the lowest level to the top."""
    proof = ""
    for level in levels[:-1]:
        begin = place // fan * fan
        left, right = "".join(level[begin:place]), "".join(level[place + 1 : begin + fan])
        proof += left + right
        value = sha((left + value + right).encode())
        place //= fan
    return proof, value


def plain(data, fan=16):
    """``data``: rows (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in data:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf_of(r), r))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = [climb([x[2] for x in sorted(groups[s], key=lambda x: x[:3])], fan) for s in order]
    top = climb([t[-1][0] for t in trees], fan)
    out = []
    for number, s in enumerate(order):
        for place, (_, _, leaf, r) in enumerate(sorted(groups[s], key=lambda x: x[:3])):
            bad = zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 5 == 0
            low = None if r[4] is None else r[4].encode().lower().decode()
            claim = leaf_of((*r[:4], low)) if bad else leaf
            p1, held = path(trees[number], place, claim, fan)
            p2, folded = path(top, number, held, fan)
            out.append((r[0], leaf, trees[number][-1][0], top[-1][0], sha((p1 + p2).encode()), folded, folded == top[-1][0]))
    return sorted(out, key=repr)


def found(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


def frame(spark, data):
    return docs(spark, [(i, text, lang, source) for i, source, lang, _, text in data]).withColumn(
        "n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")))


def tampered():
    return remainder(F.col("doc_id"), 5) == 0


def test_odd_rows(spark):
    data = [(i, s, lang, None if t is None else len(t), t) for i, t, lang, s in rows()]
    assert found(check_tampered(frame(spark, data).repartition(5), tampered())) == plain(data)


@pytest.mark.parametrize(("fan", "part"), [(2, 3), (3, 7), (16, 64)])
def test_hot_source_and_many_small_ones(spark, fan, part):
    """Partitions that cut through trees, and trees smaller than a partition."""
    draw = random.Random(fan)
    data = [(i * 3 % 1009, "hot" if i % 3 == 0 else draw.choice([None, "", "é", *[f"s{j}" for j in range(40)]]), "en", 6, f"Text {i % 10}") for i in range(400)]
    data += [data[9]] * 30
    manifest = build(frame(spark, data), fan=fan, rows_per_part=20)
    got = found(prove(manifest, leaves_per_part=part))
    assert [r[:5] for r in got] == [r[:5] for r in plain(data, fan)]
    assert all(r[6] and r[5] == r[3] for r in got)
    wrong = prove(build(frame(spark, data), fan=fan, rows_per_part=20, claim=F.sha2(F.lit("x"), 256)), leaves_per_part=part)
    assert not any(r["verified"] for r in wrong.collect())


def test_proofs_of_some_leaves(spark):
    """A partition that holds only some leaves of a tree fetches their siblings too."""
    data = [(i, f"s{i % 3}", "en", 6, f"Text {i}") for i in range(300)]
    manifest = build(frame(spark, data), fan=4)
    some = found(prove(manifest, wanted=F.col("id") % 7 == 0, leaves_per_part=50))
    assert some == [r for r in found(prove(manifest)) if r[0] % 7 == 0]


def test_missing_nodes_are_the_least_set():
    assert missing(np.array([5]), 1, 16) == []
    assert missing(np.arange(16), 16, 16) == []
    assert missing(np.array([0, 1]), 5, 2) == [(1, 1), (2, 1)]
    draw = random.Random(1)
    for _ in range(200):
        fan, n = draw.choice([2, 3, 16]), draw.randint(2, 300)
        known = sorted(draw.sample(range(n), draw.randint(1, n)))
        levels = climb([str(i) for i in range(n)], fan)
        got = set(missing(np.array(known), n, fan))
        # every sibling of a leaf's path is either missing or lies above a known leaf; no missing node does
        above = {(level, k // fan**level) for k in known for level in range(len(levels))}
        needed = {(level, p) for k in known for level in range(len(levels) - 1)
                  for p in range(k // fan ** (level + 1) * fan, min((k // fan ** (level + 1) + 1) * fan, len(levels[level])))}
        assert got == needed - above


def test_empty_and_single(spark):
    assert check_tampered(frame(spark, []), tampered()).count() == 0
    one = [(3, None, None, 4, "Text")]
    assert found(check_tampered(frame(spark, one), tampered())) == plain(one)


def test_query_matches_sql(spark):
    assert differences(spark, "/root/testdata/sf0.001", "op11_merkle")[:2] == ([], [])
