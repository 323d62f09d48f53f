import hashlib
import math
import struct
from collections import Counter

import xxhash
from pyspark.sql import functions as F
from samples import docs, empty, prose, rows

from relaygrid.llm import fingerprints as fp
from relaygrid.llm.fingerprints import fingerprints

MASK = (1 << 64) - 1


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def hash_of(*values):
    """Spark's chain of 64-bit hashes over longs ("q") and ints ("i")."""
    seed = 42
    for kind, v in values:
        seed = xxhash.xxh64(struct.pack("<" + kind, v), seed=seed).intdigest()
    return seed


def uniform(bits, shift):
    return ((bits >> shift) & ((1 << 26) - 1)) + 0.5


def sample_row(counts, samples):
    """Least offer of each position, term by term."""
    out = []
    for k in range(samples):
        best = None
        for word, w in counts.items():
            term = signed(xxhash.xxh64(word, seed=42).intdigest())
            a = hash_of(("q", term), ("i", k))
            b = hash_of(("q", signed(a)))
            r = -math.log(uniform(a, 0) * uniform(a, 26) / 2.0**52)
            ln_c = math.log(-math.log(uniform(b, 0) * uniform(b, 26) / 2.0**52))
            beta = (((a >> 52) & 4095) * 4096 + ((b >> 52) & 4095) + 0.5) / 2.0**24
            t = math.floor(math.log(w) / r + beta)
            offer = (int((ln_c - r * (t - beta + 1.0)) * 2.0**24), (term ^ (t << 15)) & (2**31 - 1))
            best = offer if best is None or offer < best else best
        out.append(best)
    return [None if b is None else b[1] & 0xFFFF for b in out]


def like(a, b):
    a, b = [x for x in a if x is not None], [x for x in b if x is not None]
    if not a and not b:
        return 1.0
    return sum(x == y for x, y in zip(a, b, strict=True)) / len(a) if a and b else 0.0


def words(text):
    return Counter(text.encode().split())


def shown(row):
    return "".join(f"{x:04x}" for x in row if x is not None)


def plain(data, samples):
    """``data``: (id, text); null ids last, equal ids by the hash of the text."""
    tie = lambda t: signed(xxhash.xxh64(t.encode(), seed=42).intdigest())
    order = sorted(((i, t or "") for i, t in data), key=lambda r: (r[0] is None, -(r[0] or 0), tie(r[1])))
    out = []
    for at, (i, text) in enumerate(order):
        after = order[(at + 1) % len(order)][1]
        half = len(text) // 2
        changed = text[: len(text) - half] + after[:half]
        mine, edited, other = (sample_row(words(t), samples) for t in (text, changed, after))
        out.append((i, len(text), hashlib.sha256(changed.encode()).hexdigest(), shown(mine), shown(edited), like(mine, edited), like(mine, other)))
    return sorted(out, key=repr)


def found(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


def test_odd_rows(spark):
    data = [(i, t if t is None or len(t) < 5000 else t[:5000], lang, s) for i, t, lang, s in rows()]
    assert found(fingerprints(docs(spark, data).repartition(5), samples=8)) == plain([r[:2] for r in data], 8)


def test_many_slots(spark, monkeypatch):
    """Slots of a few rows: each row still meets the next one, the last the first; equal rows and a hot id too."""
    monkeypatch.setattr(fp, "SLOT_ROWS", 4)
    data = [(i % 60 if i % 3 else 7, prose(i % 50, 5 + i % 7), "en", "a") for i in range(120)]
    data += [(None, prose(90 + i, 6), "en", "a") for i in range(9)] + [(7, "the same", "en", "a")] * 12
    assert found(fingerprints(docs(spark, data).repartition(7), samples=4)) == plain([r[:2] for r in data], 4)


def test_slots_grow_beyond_the_most(spark, monkeypatch):
    """No more slots than allowed, whatever the rows: the same result from longer ones."""
    monkeypatch.setattr(fp, "SLOT_ROWS", 2)
    monkeypatch.setattr(fp, "MOST_SLOTS", 3)
    data = [(i % 40 if i % 5 else None, prose(i, 4 + i % 5), "en", "a") for i in range(70)]
    result = fingerprints(docs(spark, data).repartition(5), samples=4)
    assert found(result) == plain([r[:2] for r in data], 4)
    assert len(fp._starts(docs(spark, data).select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("tie")), [F.col("id").desc_nulls_last(), F.col("tie")])[0]) == 3


def test_plan_names_the_starts_twice(spark, monkeypatch):
    """the list of starts is text in every picture of the plan that the driver makes; it must not stand there per step."""
    monkeypatch.setattr(fp, "SLOT_ROWS", 1)
    data = spark.range(1000).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words "), F.col("id")).alias("text"))
    plan = fingerprints(data, samples=2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("[777,") == 2
    assert fp.MOST_SLOTS <= 4096


def test_string_ids(spark):
    data = [("b", "x y"), (None, "x z"), ("a'\"", "x y"), ("c", "z z")]
    found_ids = [r["doc_id"] for r in fingerprints(spark.createDataFrame(data, "doc_id string, text string")).collect()]
    assert sorted(map(str, found_ids)) == sorted(str(i) for i, _ in data)


def test_collisions_equal_generalised_jaccard(spark):
    """Rates over many positions against the exact similarity of weighted words."""
    texts = [prose(1, 200), prose(2, 60) + " " + prose(1, 100), prose(3, 40) * 3, "a a a a b", "a b b b c"]
    data = [(i, t, "en", "a") for i, t in enumerate(texts)]
    samples = 2048
    for r in fingerprints(docs(spark, data), samples=samples).collect():
        mine, other = words(texts[r["doc_id"]]), words(texts[r["doc_id"] - 1])
        exact = (mine & other).total() / (mine | other).total()
        assert abs(r["near_next"] - exact) < 4 * math.sqrt(exact * (1 - exact) / samples) + 1e-9


def test_single_and_empty(spark):
    assert fingerprints(empty(spark)).count() == 0
    (one,) = fingerprints(docs(spark, [(1, "a b c", "en", "a")])).collect()
    assert one["near_next"] == 1.0
    (bare,) = fingerprints(docs(spark, [(None, None, "en", "a")])).collect()
    assert (bare["n_chars"], bare["fingerprint"], bare["near_edited"], bare["near_next"]) == (0, "", 1.0, 1.0)


def test_no_python_in_the_plan(spark):
    """Native: no Python node, and texts cross the network once."""
    plan = fingerprints(docs(spark).where(F.col("doc_id") > 0))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan
    assert plan.count("Exchange") == 1
