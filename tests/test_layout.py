"""Stored layouts: a log that progress prunes, and tables placed by key."""

import pytest
from pyspark.sql import functions as F

from relaygrid import schemas
from relaygrid.catalog import adapter as A
from relaygrid.operators import dedupe, layout, oplog, purge
from relaygrid.session import work_path

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def nodes(plan):
    """All nodes of a plan that ran, through adaptive stages."""
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan":
        return nodes(plan.executedPlan())
    if name.endswith("QueryStage"):
        return nodes(plan.plan())
    below = plan.children()
    return [plan, *[n for i in range(below.size()) for n in nodes(below.apply(i))]]


def opened(df, column):
    """Files that the scans reading ``column`` opened."""
    df.collect()
    scans = [n for n in nodes(df._jdf.queryExecution().executedPlan()) if n.nodeName().startswith("Scan parquet") and column in n.schema().simpleString()]
    return sum(n.metrics().apply("numFiles").value() for n in scans)


@pytest.fixture(scope="module")
def stored(spark):
    """A log in two appends that share bands."""
    path, log = work_path(spark, "log"), A.topic_log(spark, SF)
    layout.append_log(log.where("offset < 330"), path, band=100)
    layout.append_log(log.where("offset >= 330"), path, band=100)
    return layout.stored_log(spark, path)


def test_stored_log_keeps_every_row(spark, stored):
    log = A.topic_log(spark, SF)
    assert rows(stored.rows.select(*layout.COLUMNS)) == rows(log)
    assert rows(layout.stored_watermarks(stored)) == rows(oplog.watermarks(log))
    assert stored.segments.agg(F.sum("n")).first()[0] == log.count()


@pytest.mark.parametrize("start", ["earliest", "latest"])
@pytest.mark.parametrize("group", ["grid-alpha-live", "grid-beta-historic", "nobody"])
def test_resume_is_the_same_as_over_the_plain_log(spark, stored, start, group):
    log, offsets = A.topic_log(spark, SF), A.offsets(spark, SF)
    assert rows(layout.resume_stored(stored, offsets, start, group)) == rows(oplog.resume_scan(log, offsets, start, group))


def test_only_unread_segments_are_opened(spark, stored):
    ends = oplog.watermarks(A.topic_log(spark, SF)).withColumn("consumer_group", F.lit("g"))
    all_files = opened(layout.resume_stored(stored, spark.createDataFrame([], schemas.OFFSETS), "earliest", "g"), "value")
    assert all_files == stored.segments.count()
    behind = layout.resume_stored(stored, ends.withColumn("committed", F.col("high_watermark") - 1), "earliest", "g")
    assert opened(behind, "value") == ends.count() == behind.count()
    done = layout.resume_stored(stored, ends.withColumn("committed", F.col("high_watermark")), "earliest", "g")
    assert opened(done, "value") == 0 and done.count() == 0


def test_a_failed_append_is_not_read(spark):
    path, log = work_path(spark, "log"), A.topic_log(spark, SF)
    layout.append_log(log.where("offset < 500"), path)
    # rows without their segments
    half = log.where("offset >= 500").withColumn("segment", F.lit("half"))
    half.write.partitionBy("topic", "segment").parquet(f"{path}/rows/append=half")
    none = spark.createDataFrame([], schemas.OFFSETS)
    assert rows(layout.resume_stored(layout.stored_log(spark, path), none, "earliest", "g")) == rows(log.where("offset < 500"))
    layout.append_log(log.where("offset >= 500"), path)
    assert rows(layout.resume_stored(layout.stored_log(spark, path), none, "earliest", "g")) == rows(log)


def test_bands_with_few_rows_share_a_segment(spark):
    """Files are as many as the rows fill, whatever the number of bands; no row is lost, also without an offset."""
    path = work_path(spark, "log")
    cells = [("t", 0, n, "k", "v", None) for n in range(1000)] + [("u", 1, 7, "k", "v", None), ("u", 1, None, "k", "v", None), (None, 0, 5, "k", "v", None)]
    log = spark.createDataFrame(cells, schemas.TOPIC_LOG)
    layout.append_log(log, path, band=10, fill=100)
    stored = layout.stored_log(spark, path)
    assert rows(stored.rows.select(*layout.COLUMNS)) == rows(log)
    held = {(r["first"], r["last"], r["n"]) for r in stored.segments.where("topic = 't'").collect()}
    assert held == {(n, n + 99, 100) for n in range(0, 1000, 100)}
    assert stored.segments.count() == 13
    offsets = spark.createDataFrame([("g", "t", 0, 950)], schemas.OFFSETS)
    assert rows(layout.resume_stored(stored, offsets, "earliest", "g")) == rows(oplog.resume_scan(log, offsets, "earliest", "g"))


def test_unknown_start(stored, spark):
    with pytest.raises(ValueError):
        layout.resume_stored(stored, spark.createDataFrame([], schemas.OFFSETS), "middle", "g")


def skewed(spark):
    """A third of all messages share a key; some have none, some an empty one, some are exempt or no binaries."""
    flags = "struct(seq % 11 = 0 AS bypass_cache, seq % 13 = 0 AS expedite) AS flags"
    key = "CASE WHEN seq % 3 = 0 THEN 'hot' WHEN seq % 50 = 1 THEN '' WHEN seq % 50 = 4 THEN NULL ELSE concat('k', seq % 97) END AS kafka_key"
    return spark.range(900).selectExpr("id AS seq").selectExpr("seq", "if(seq % 17 = 0, 'status', 'binary') AS model", key, flags, "concat('c', seq % 2) AS consumer")


def exchanges(df):
    """Exchanges of the plan as it would run without any broadcast."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange" in line]


@pytest.fixture
def no_broadcast(spark):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    yield lambda: spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


@pytest.mark.parametrize("buckets", [1, 4, 32])
def test_placed_tables_give_the_same(spark, buckets):
    df = skewed(spark)
    placed = layout.place_by_key(df, "kafka_key", buckets)
    assert rows(placed.even.unionByName(placed.hot)) == rows(df)
    hot = {r[0] for r in placed.hot.select("kafka_key").distinct().collect()}
    assert ("hot" in hot) == (buckets > 3) and len(hot) <= buckets
    for consumer in ([], ["consumer"]):
        want = rows(dedupe.first_seen(df, consumer).select("seq", "dedupe_reason"))
        assert rows(layout.placed_first_seen(placed, consumer).select("seq", "dedupe_reason")) == want
    register = spark.createDataFrame([("ids", k, None) for k in ("hot", "k1", "", "absent")] + [("link", "k2", None)], "kind string, token string, bound timestamp")
    assert rows(layout.placed_purge_by_id(placed, register)) == rows(purge.purge_by_id(df, register))
    placed.drop()


def test_placed_log_compacts_the_same(spark):
    log = A.topic_log(spark, SF)
    extra = [("t", 0, 5, None, "first", None), ("t", 1, 5, None, "second", None), ("t", 0, 9, "gone", None, None)]
    log = log.unionByName(spark.createDataFrame(extra, schemas.TOPIC_LOG))
    columns = ["topic", "key", "partition", "offset", "value"]
    found = layout.placed_compacted(layout.place_by_key(log, "key", 8))
    assert rows(found.select(*columns)) == rows(oplog.compacted_view(log).select(*columns))


def test_work_by_key_moves_no_placed_row(spark, no_broadcast):
    """Each plan has the exchanges of its narrow side at most, and none above the placed table."""
    placed = layout.place_by_key(skewed(spark), "kafka_key", 8)
    register = spark.createDataFrame([("ids", "k1", None)], "kind string, token string, bound timestamp")
    log = layout.place_by_key(A.topic_log(spark, SF), "key", 8)
    no_broadcast()
    alone = lambda p: layout.Placed(p.even, p.hot.where(F.lit(False)), p.key, p.tables)
    assert not exchanges(layout.placed_first_seen(alone(placed), ["consumer"]))
    assert not exchanges(layout.placed_compacted(alone(log)))
    moved = exchanges(layout.placed_purge_by_id(alone(placed), register))
    assert moved and all("_token" in line for line in moved)


def test_empty_tables(spark):
    placed = layout.place_by_key(skewed(spark).where("seq < 0"), "kafka_key", 4)
    assert layout.placed_first_seen(placed, []).count() == 0
    path = work_path(spark, "log")
    layout.append_log(A.topic_log(spark, SF).where("offset < 0"), path)
    assert layout.resume_stored(layout.stored_log(spark, path), A.offsets(spark, SF), "earliest", "grid-alpha-live").count() == 0
