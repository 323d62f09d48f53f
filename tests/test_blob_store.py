"""The store against plain dictionaries; ranges read the chunks they touch, copies and deletions no byte."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from relaygrid.operators import blob_store

AT = "2024-01-01 00:00:00"


def sha(data):
    return hashlib.sha256(data).hexdigest()


def uploads(spark, rows):
    """(id, source, label, bytes, expected hash)."""
    return spark.createDataFrame(rows, "upload_id long, source string, label string, data binary, expected_sha256 string")


def contents(store):
    """sha256 -> bytes, put together from the chunks; each chunk is there once."""
    parts = {}
    for r in store.chunks.collect():
        assert r.chunk not in parts.setdefault(r.sha256, {})
        parts[r.sha256][r.chunk] = bytes(r.bytes)
    return {k: b"".join(v[i] for i in sorted(v)) for k, v in parts.items()}


def refs(store):
    return {(r.source, r.label, r.sha256) for r in store.refs.collect()}


@pytest.fixture(scope="module")
def made(spark):
    draw = random.Random(4)
    data = [bytes(draw.randrange(256) for _ in range(n)) for n in (1, 15, 16, 17, 31, 32, 33, 100)]
    rows = [(i, f"s{i % 2}", "content", d, None) for i, d in enumerate(data)]
    rows += [(20 + i, "again", "content", d, sha(d)) for i, d in enumerate(data[:4])]
    rows += [(30, "s0", "content", data[7], "0" * 64), (31, "s0", "content", b"", None), (32, "s0", "content", None, None), (33, "s1", "content", data[1], None)]
    store, refused = blob_store.ingest(blob_store.empty(spark, 16), uploads(spark, rows), AT)
    return data, store, refused


def test_bytes_are_kept_once(made):
    data, store, refused = made
    assert contents(store) == {sha(d): d for d in data}
    assert len(refs(store)) == len(data) + 4
    assert sorted(r.upload_id for r in refused.collect()) == [30, 31, 32]


def test_what_the_store_holds_is_not_brought_again(spark, made):
    data, store, _ = made
    more, _ = blob_store.ingest(store, uploads(spark, [(1, "new", "content", data[7], None), (2, "new", "content", b"fresh", None), (3, "s0", "content", data[0], None)]), AT)
    assert contents(more) == {**{sha(d): d for d in data}, sha(b"fresh"): b"fresh"}
    assert refs(more) - refs(store) == {("new", "content", sha(data[7])), ("new", "content", sha(b"fresh"))}


RANGES = {
    "": lambda d: d, "bytes=0-0": lambda d: d[:1], "bytes=3-9": lambda d: d[3:10], "bytes=15-16": lambda d: d[15:17], "bytes=16-": lambda d: d[16:],
    "bytes=-5": lambda d: d[-5:], "bytes=-500": lambda d: d, "bytes=90-2000": lambda d: d[90:], "bytes=500-600": lambda d: b"", "bytes=500-": lambda d: b"",
}


def asked(spark, data):
    rows = [(i * 100 + j, f"s{i % 2}", "content", sha(d), header) for i, d in enumerate(data) for j, header in enumerate([*RANGES, "bytes=9-3", "nonsense", None])]
    rows.append((9999, "s0", "content", "0" * 64, ""))
    return spark.createDataFrame(rows, "n long, source string, label string, sha256 string, range string")


def test_ranges(spark, made):
    data, store, _ = made
    got = {r.n: r for r in blob_store.read_ranges(asked(spark, data), store, "n").collect()}
    for i, d in enumerate(data):
        for j, cut in enumerate([*RANGES.values(), None, None, RANGES[""]]):
            r = got[i * 100 + j]
            assert r.found and (r.error is None) == (cut is not None)
            assert (None if r.part is None else bytes(r.part)) == (None if cut is None else cut(d))
    assert not got[9999].found and got[9999].part is None and len(got) == len(data) * 13 + 1


def test_a_range_meets_only_its_chunks(spark, made):
    data, store, _ = made
    wanted = blob_store.wanted_chunks(asked(spark, data).where("n >= 700"), store, "n").groupBy("n").agg(F.sort_array(F.collect_list("chunk")).alias("c"))
    got = {r.n - 700: r.c for r in wanted.collect()}
    assert got[1] == [0] and got[2] == [0] and got[3] == [0, 1] and got[5] == [5, 6] and got[7] == [5, 6] and got[8] == [] and got[10] == []


def test_bytes_go_with_the_last_reference(spark, made):
    data, store, _ = made
    copies = spark.createDataFrame([("s0", "extra", "content", sha(data[0]))], "source_from string, source_to string, label string, sha256 string")
    copied, report = blob_store.copy(store, copies)
    assert [r.outcome for r in report.collect()] == ["copied"]
    gone = [("s0", sha(data[0])), ("again", sha(data[0])), ("s0", sha(data[4])), ("s1", sha(data[1]))]
    requests = spark.createDataFrame([(s, "content", h, 0) for s, h in gone], "source string, label string, sha256 string, if_older_than int")
    left, _ = blob_store.delete(copied, requests, "2024-02-01 00:00:00")
    # the first content has its copy, the second an address of another source
    assert {r.sha256 for r in blob_store.unreferenced(left).collect()} == {sha(data[4])}
    assert set(contents(blob_store.sweep(left))) == {sha(d) for d in data} - {sha(data[4])}


def test_copies_and_deletions_read_no_byte(spark, made):
    _, store, _ = made
    for frame in (store.refs, blob_store.unreferenced(store)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "bytes:binary" not in plan and "data:binary" not in plan
