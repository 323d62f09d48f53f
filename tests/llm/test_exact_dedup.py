import hashlib
import re

import pytest
from oracle_llm import differences
from pyspark.sql import functions as F
from samples import docs, empty, rows

from relaygrid.llm.exact_dedup import drop_exact_copies, exact_dedup


def plain(data):
    norm = [(i, re.sub("[\x20\x09-\x0d]+", " ", t or "")) for i, t, *_ in data]
    groups = {}
    for i, t in norm:
        groups.setdefault(t, []).append(i)
    out, seen = [], set()
    for i, t in norm:
        ids = [x for x in groups[t] if x is not None]
        keep = min(ids) if ids else None
        out.append((i, keep, len(groups[t]), i == keep and (i, t) not in seen, hashlib.sha256(t.encode()).hexdigest()))
        seen.add((i, t))
    return sorted(out, key=repr)


def found(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


def test_odd_rows(spark):
    assert found(exact_dedup(docs(spark))) == plain(rows())


def test_empty(spark):
    assert exact_dedup(empty(spark)).count() == 0
    assert drop_exact_copies(empty(spark)).count() == 0


def test_equal_hashes_are_told_apart_by_their_bytes(spark):
    """With a hash that is the same for all texts, groups still hold equal texts only."""
    assert found(exact_dedup(docs(spark), hasher=lambda norm: F.md5(F.lit("same").cast("binary")))) == plain(rows())


def test_hot_text(spark):
    data = [(i, "the same  text" if i % 3 else f"text {i}", "en", "a") for i in range(300)]
    assert found(exact_dedup(docs(spark, data).repartition(7))) == plain(data)


def test_stage_keeps_columns_and_one_row_of_each_text(spark):
    stay = drop_exact_copies(docs(spark))
    assert stay.columns == docs(spark).columns
    kept = sorted([(r["doc_id"], r["text"]) for r in stay.collect()], key=repr)
    assert [i for i, _ in kept] == sorted([1, 2, 4, 5, 7, 8, 9, 10, 11, 13, None], key=repr)


@pytest.mark.parametrize("name", ["op9_exact_dedup", "op4_licences"])
def test_queries_match_sql(spark, name):
    assert differences(spark, "/root/testdata/sf0.001", name)[:2] == ([], [])
