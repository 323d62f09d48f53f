import pytest
from pyspark.sql import functions as F

from relaygrid import schemas
from relaygrid.functions import content as C
from relaygrid.functions import routing
from relaygrid.operators.consumers import ConsumerSpec, subscriptions
from relaygrid.plans.fetch import feeds
from relaygrid.sources import batches


@pytest.mark.parametrize("header, start, length", [
    ("", 0, -1), ("franks=2:10", None, None), ("bytes=", None, None), ("bytes=a-f", None, None), ("bytes=10-f", None, None),
    ("bytes=-", None, None), ("bytes=100-", 100, -1), ("bytes=-100", -100, 100), ("bytes=100-200", 100, 101),
    ("bytes=-100-200", None, None), ("bytes=200-100", None, None), ("bytes=2-2", 2, 1), ("bytes=1-2,5-6", None, None),
])
def test_byte_ranges(spark, header, start, length):
    r = spark.range(1).select(C.parse_byte_range(F.lit(header)).alias("r")).first().r
    assert (r.start, r.length) == (start, length) and (r.error is None) == (start is not None)


@pytest.mark.parametrize("start, length, part", [(0, -1, b"abcdef"), (2, 3, b"cde"), (-2, 2, b"ef"), (4, -1, b"ef"), (-9, 9, b"abcdef")])
def test_slices(spark, start, length, part):
    df = spark.createDataFrame([(bytearray(b"abcdef"),)], "data binary")
    assert bytes(df.select(C.slice_bytes(F.col("data"), F.lit(start), F.lit(length)).alias("p")).first().p) == part


def test_hashes(spark):
    import hashlib

    data = b"some content\n" * 7
    row = spark.createDataFrame([(bytearray(data),)], "data binary").select(*C.content_hashes(F.col("data"))).first()
    assert (row.sha256, row.sha512) == (hashlib.sha256(data).hexdigest(), hashlib.sha512(data).hexdigest())
    assert (row.sha1, row.md5, row["size"]) == (hashlib.sha1(data).hexdigest(), hashlib.md5(data).hexdigest(), len(data))
    empty = spark.createDataFrame([(bytearray(b""),)], "data binary").select(*C.content_hashes(F.col("data"))).first()
    assert (empty.mime, empty.magic, empty.file_format) == ("inode/x-empty", "empty", "unknown")


def test_task_id_epoch(spark):
    df = spark.createDataFrame([("md5sum.my-plugin.my.version.123754",), ("none",)], "id string")
    assert [r.e for r in df.select(C.epoch_of_id(F.col("id")).alias("e")).collect()] == [123754, None]


def test_topic_patterns():
    naming = routing.Naming("grid", "dev01")
    assert routing.binary_topic_pattern([], [], naming) == r"^grid\.dev01\.[^\.]+\.binary\.[^\.]+$"
    assert routing.binary_topic_pattern(["hunt", "triage"], ["sourced"], naming) == r"^grid\.dev01\.(hunt|triage)\.binary\.(sourced)$"
    with pytest.raises(ValueError):
        routing.binary_topic_pattern([], ["confabulated"])


@pytest.mark.parametrize("spec, expected", [
    (ConsumerSpec("p", require_expedite=True, require_historic=True), [("expedite", "latest"), ("live", "latest"), ("historic", "earliest")]),
    (ConsumerSpec("p", require_live=False, require_historic=True, require_events=["sourced"]), [("historic", "earliest")]),
    (ConsumerSpec("p", model="status", require_expedite=True), [("live", "latest")]),
])
def test_feeds_agree_as_table_and_as_list(spark, spec, expected):
    listed = feeds(spec)
    assert [(f.name, f.start) for f in listed] == expected
    table = subscriptions(spark.range(1).select(spec.column().alias("s")).select("s.*")).orderBy("priority").collect()
    assert [(r.feed, r.start, r.pattern) for r in table] == [(f.name, f.start, f.pattern) for f in listed]


def test_batches(spark):
    good = '{"model_version":6,"action":"sourced","source":{"name":"s","path":[{}]},"entity":{"sha256":"x"}}'
    bad = good.replace('"s"', '""')
    bodies = spark.createDataFrame([
        (0, good), (1, f"[{good}, {bad}]"), (2, "[]"), (3, "[" + good), (4, good.replace(":6", ":5")),
        (5, f'[{good}, {{"model_version":"six"}}]'), (6, f"[{good},{good.replace(':6', ':3')}]"),
        (7, good + " tail"), (8, f"{good},{good}"), (9, f"[{good}] tail"), (10, f" [{good}]"),
    ], "batch_id int, body string")
    parsed = batches.parse_event_batches(bodies, "binary")
    got = {r.batch_id: (r.batch_error is None, r.total_ok, r.total_failures) for r in parsed.summary().collect()}
    assert got == {0: (True, 1, 0), 1: (True, 1, 1), 2: (False, 0, 0), 3: (False, 0, 0), 4: (False, 0, 0), 5: (False, 0, 0), 6: (False, 0, 0), 7: (False, 0, 0), 8: (False, 0, 0), 9: (False, 0, 0), 10: (True, 1, 0)}
    assert [(r.batch_id, r.position) for r in parsed.ok().orderBy("batch_id").collect()] == [(0, 0), (1, 0), (10, 0)]
    failure = parsed.failures().collect()
    assert [(r.batch_id, r.error) for r in failure] == [(1, "missing source name")] and '"sha256":"x"' in failure[0].raw


def test_schemas_round_trip():
    assert set(schemas.BY_MODEL) == {"binary", "status", "plugin", "insert", "delete", "download"}
