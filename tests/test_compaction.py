"""Last rows are found by position: no payload is sorted, and earlier results are not looked through again."""

import pytest
from pyspark.sql import functions as F

from relaygrid import schemas
from relaygrid.catalog import adapter as A
from relaygrid.operators import consumers, inject, oplog
from relaygrid.session import work_path

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def plain(log):
    """The last value per topic and key, by a dictionary."""
    last = {}
    for r in log.collect():
        at = (r.topic, r.key)
        if at not in last or (r.offset, r.partition) > last[at][:2]:
            last[at] = (r.offset, r.partition, r.value)
    return sorted(((t, k, p, o, v) for (t, k), (o, p, v) in last.items() if v is not None), key=repr)


def test_compacted_view_against_a_dictionary(spark):
    log = A.topic_log(spark, SF)
    extra = [("t", 0, 5, None, "first", None), ("t", 1, 5, None, "second", None), ("t", 0, 2**40, "k", "far", None), ("t", 7, 3, "k", "near", None), ("t", 0, 9, "gone", None, None)]
    log = log.unionByName(spark.createDataFrame(extra, schemas.TOPIC_LOG))
    assert rows(oplog.compacted_view(log).select("topic", "key", "partition", "offset", "value")) == plain(log)


def test_compacting_onto_an_earlier_result(spark):
    """Any cut of the log gives what one compaction of all of it gives."""
    log = A.topic_log(spark, SF)
    columns = ["topic", "key", "partition", "offset", "value"]
    for cut in (0, 300, 999, 5000):
        base, added = log.where(F.col("offset") < cut), log.where(F.col("offset") >= cut)
        both = oplog.compact_onto(oplog.compacted_view(base), added)
        assert rows(both.select(*columns)) == rows(oplog.compacted_view(log).select(*columns))


@pytest.mark.parametrize("find", [
    lambda spark: oplog.latest_positions(A.topic_log(spark, SF), ["topic", "key"]), lambda spark: oplog.compacted_view(A.topic_log(spark, SF)),
    lambda spark: inject.latest_inserts(A.inserts(spark, SF)), lambda spark: consumers.latest_registrations(A.consumers(spark, SF), A.NOW),
])
def test_no_payload_is_sorted(spark, find):
    plan = find(spark)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan


def test_values_stay_out_of_the_search(spark):
    """The aggregate reads keys and positions of a stored log, not its values."""
    path = work_path(spark, "log")
    A.topic_log(spark, SF).write.parquet(path)
    plan = oplog.latest_positions(spark.read.parquet(path), ["topic", "key"])._jdf.queryExecution().executedPlan().toString()
    read = [line for line in plan.splitlines() if "ReadSchema" in line]
    assert read and not any("value" in line for line in read)
