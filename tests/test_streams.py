"""A stream over many files ends with the result of the batch operator."""

from types import SimpleNamespace

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from relaygrid import schemas
from relaygrid.catalog import adapter as A
from relaygrid.functions.routing import Naming
from relaygrid.operators import inject, pause, purge, replay
from relaygrid.operators.tasks import lost_tasks
from relaygrid.plans.reprocess import reprocess
from relaygrid.session import work_path
from relaygrid.streaming import keyed, stateful

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def slices(spark):
    """The events cut into three files by time, so three micro-batches."""
    folder = work_path(spark, "slices")
    events = A.table(spark, SF, "events")
    for n in range(3):
        part = events.where((F.col("event_id") >= n * 334) & (F.col("event_id") < (n + 1) * 334))
        part.coalesce(1).write.mode("append").parquet(folder)
    return folder


def stream(spark, folder):
    return spark.readStream.schema(schemas.EVENTS_TABLE).option("maxFilesPerTrigger", 1).parquet(folder)


def drain(df, name, checkpoint=None):
    """What a run gives; runs with one ``checkpoint`` go on from each other and add to one output."""
    spark = df.sparkSession
    output = f"{checkpoint}-output" if checkpoint else work_path(spark, name)
    keyed.run_caught_up(df, checkpoint or work_path(spark, name), output=output)
    return spark.read.schema(df.schema).parquet(output)


@pytest.fixture(scope="module")
def backwards(spark):
    """The events in three files, newest first."""
    folder = work_path(spark, "backwards")
    events = A.table(spark, SF, "events")
    for n in (2, 1, 0):
        part = events.where((F.col("event_id") >= n * 334) & (F.col("event_id") < (n + 1) * 334))
        part.coalesce(1).write.mode("append").parquet(folder)
    return folder


EXEMPT = "flags.bypass_cache OR flags.expedite"


@pytest.mark.parametrize("order", ["slices", "backwards"])
def test_dedupe_stream_gives_each_key_once(spark, order, request):
    """However late a message is by its own time: rows in = rows out + repeats."""
    kept = drain(stateful.dedupe_stream(A.messages_of(stream(spark, request.getfixturevalue(order))), [], "1 hour"), "dedupe").cache()
    batch = A.messages(spark, SF).where(f"{EXEMPT} OR kafka_key <> ''")
    assert kept.where(EXEMPT).count() == batch.where(EXEMPT).count() > 0
    keys = [r.kafka_key for r in kept.where(f"NOT ({EXEMPT})").collect()]
    assert len(keys) == len(set(keys)) == batch.where(f"NOT ({EXEMPT})").select("kafka_key").distinct().count()


def test_dedupe_stream_forgets_by_the_clock_of_arrival(spark):
    """A key comes out again when its time to live is long over, not before."""
    folder, clock = work_path(spark, "days"), F.timestamp_seconds(F.col("seq") * 3600)
    # the clock moves on with another key's rows
    for hour, key in ((100, "one"), (101, "one"), (102, "one"), (120, "two"), (121, "two"), (122, "one"), (140, "two"), (141, "two"), (150, "one")):
        row = A.messages(spark, SF).where("action = 'extracted' AND NOT (flags.bypass_cache OR flags.expedite)").limit(1)
        row.withColumns({"seq": F.lit(hour).cast("long"), "kafka_key": F.lit(key)}).coalesce(1).write.mode("append").parquet(folder)
    rows = spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)
    kept = drain(stateful.dedupe_stream(rows, [], "3 hours", arrived=clock), "dedupe-ttl")
    assert sorted(r.seq for r in kept.where("kafka_key = 'one'").collect()) == [100, 122, 150]


def tasks(spark, folder, rows):
    """Append (task, seconds, finished) as one file."""
    frame = spark.createDataFrame(rows, "dequeued string, s long, finished boolean").coalesce(1)
    frame.select("dequeued", F.timestamp_seconds("s").alias("started_at"), "finished").write.mode("append").parquet(folder)


def lost_ids(spark, folder, checkpoint, now, **how):
    rows = spark.readStream.schema("dequeued string, started_at timestamp, finished boolean").option("maxFilesPerTrigger", 1).parquet(folder)
    starts, finishes = rows.where("NOT finished").drop("finished"), rows.where("finished").select("dequeued")
    found = keyed.lost_task_stream(starts, finishes, lost_after_s=600, now=F.timestamp_seconds(F.lit(now)), **how)
    return sorted((r.dequeued, int(r.started_at.timestamp())) for r in drain(found, "lost", checkpoint).collect())


def test_lost_tasks_are_reported_at_their_deadline(spark):
    """No closing rows; a task is lost by the clock of the run, once; finishes may come first, starts late."""
    folder, checkpoint = work_path(spark, "tasks"), work_path(spark, "tasks-state")
    tasks(spark, folder, [("a", 1000, False), ("b", 1000, False), ("b", 1100, True), ("early", 1200, True), (None, 1000, False), ("c", 1900, False)])
    assert lost_ids(spark, folder, checkpoint, 1600) == []
    # a's deadline is over; c's is not; the start of early comes after its finish; late started long ago
    tasks(spark, folder, [("early", 1300, False), ("late", 100, False)])
    assert lost_ids(spark, folder, checkpoint, 1601) == [("a", 1000), ("late", 100)]
    tasks(spark, folder, [("d", 2000, False), ("d", 2001, True)])
    assert lost_ids(spark, folder, checkpoint, 2500) == [("a", 1000), ("late", 100)]
    tasks(spark, folder, [("e", 2400, False)])
    assert lost_ids(spark, folder, checkpoint, 2501) == [("a", 1000), ("c", 1900), ("late", 100)]


def test_lost_tasks_lie_in_state_together(spark):
    """state is called per cell, not per task; tasks of a cell end each in its own time."""
    folder, checkpoint, few = work_path(spark, "crowd"), work_path(spark, "crowd-state"), {"buckets": 2, "cells": 3}
    # every third finishes, one in seven starts late; the same task twice counts from its earlier start
    rows = [(f"t\"{i}é", 1000 + 300 * (i % 7 == 0), False) for i in range(3000)] + [("t\"1é", 1250, False)]
    tasks(spark, folder, rows + [(f"t\"{i}é", 1010, True) for i in range(0, 3000, 3)])
    assert lost_ids(spark, folder, checkpoint, 1600, **few) == []
    cells = spark.read.format("statestore").option("stateVarName", "cells").load(checkpoint)
    assert cells.count() <= 6
    open_ = [i for i in range(3000) if i % 3]
    early = sorted((f"t\"{i}é", 1000) for i in open_ if i % 7)
    tasks(spark, folder, [("tick", 5000, False)])  # time moves with rows
    assert lost_ids(spark, folder, checkpoint, 1700, **few) == early
    tasks(spark, folder, [("tick", 5000, False)])
    assert lost_ids(spark, folder, checkpoint, 1901, **few) == sorted(early + [(f"t\"{i}é", 1300) for i in open_ if not i % 7])


@pytest.mark.parametrize("how", [{}, {"buckets": 1, "cells": 1}])
def test_finishes_are_forgotten_in_time(spark, how):
    """A finish holds for twice the limit, by the clock it came with; a later one does not prolong it."""
    folder, checkpoint = work_path(spark, "kept"), work_path(spark, "kept-state")
    tasks(spark, folder, [("a", 1000, True), ("open", 1500, False)])
    assert lost_ids(spark, folder, checkpoint, 1600, **how) == []
    tasks(spark, folder, [("a", 1700, False), ("a", 1700, True), ("b", 900, False), ("b", 800, False)])
    assert lost_ids(spark, folder, checkpoint, 2800, **how) == [("b", 800), ("open", 1500)]
    tasks(spark, folder, [("a", 1800, False)])
    assert lost_ids(spark, folder, checkpoint, 2801, **how) == [("b", 800), ("open", 1500)]
    tasks(spark, folder, [("a", 1900, False), ("b", 850, False)])
    assert lost_ids(spark, folder, checkpoint, 2802, **how) == [("a", 1900), ("b", 800), ("b", 850), ("open", 1500)]


def test_packed_rows():
    """All rows of all batches, one row a bucket for each pack; a batch without rows adds none."""
    rows = [(i % 3, i, None if i % 4 == 0 else f"x{i}") for i in range(50)]
    schema = pa.schema([("bucket", pa.int64()), ("at", pa.int64()), ("body", pa.string())])
    batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), schema.types)], schema=schema) for part in (rows[:20], rows[20:])]
    batches.insert(1, pa.RecordBatch.from_pylist([], schema=schema))
    (one,) = keyed._packed(iter(batches))
    assert one.column("bucket").to_pylist() == [0, 1, 2]
    opened = [(b, *x) for b, at, body in zip(*[c.to_pylist() for c in one.columns]) for x in zip(at, body)]
    assert opened == sorted(rows, key=lambda r: r[:2])
    assert list(keyed._packed(iter(batches[1:2]))) == []


def test_lost_task_stream_equals_batch(spark, backwards):
    """Files newest first; every start that is overdue and unfinished by then."""
    flat = A.scalars_of(stream(spark, backwards))
    task = F.concat(F.col("kafka_key"), F.lit("."), F.col("seq"), F.lit(".p."), F.unix_seconds("ts")).alias("dequeued")
    found = keyed.lost_task_stream(flat.select(task, F.col("ts").alias("started_at")), flat.where("k % 3 <> 0").select(task), now=A.NOW)
    batch = A.scalars(spark, SF)
    want = lost_tasks(batch.select(task), batch.where("k % 3 <> 0").select(task), A.NOW, ttl_s=10**9)
    assert sorted(r.dequeued for r in drain(found, "lost").collect()) == sorted(r.dequeued for r in want.collect()) != []


def test_throttled_pauses_do_not_depend_on_batches(spark):
    """Three files out of order within the lateness: the batch operator's result, the last ones by a row that moves time on."""
    folder = work_path(spark, "pauses")
    at = [0, 30, 59.9999, 60, 60.000001, 121, 122, 185, 181.5, 400, 460.5, 461, 520, 521.0001, 521.0002, 590]
    rows = [(1000.0 + s, True) for s in at] + [(1000.0 + s, True) for s in at[:3]]
    for part in (rows[1::3], rows[::3], rows[2::3], [(9999.0, False)]):
        frame = spark.createDataFrame(part, "s double, is_pause boolean").coalesce(1)
        frame.select(F.timestamp_micros((F.col("s") * 1_000_000).cast("long")).alias("paused_at"), "is_pause").write.mode("append").parquet(folder)
    source = spark.readStream.schema("paused_at timestamp, is_pause boolean").option("maxFilesPerTrigger", 1).parquet(folder)
    got = drain(keyed.throttled_pause_stream(source, gap_s=60, lateness="15 minutes"), "throttled")
    want = pause.throttled_pauses(spark.read.parquet(folder).where("is_pause"), gap_s=60)
    instants = lambda df: sorted(r.paused_at for r in df.collect())
    assert instants(got) == instants(want)
    assert len(instants(got)) > 5


class _Cell:
    """State in memory, as a processor sees it."""

    def __init__(self):
        self.held, self.writes = {}, 0

    def exists(self):
        return () in self.held

    def get(self):
        return self.held[()]

    def update(self, value):
        self.updateValue((), value)

    def containsKey(self, key):  # noqa: N802
        return key in self.held

    def getValue(self, key):  # noqa: N802
        return self.held[key]

    def updateValue(self, key, value):  # noqa: N802
        self.held[key] = value
        self.writes += 1

    def removeKey(self, key):  # noqa: N802
        del self.held[key]

    def keys(self):
        return iter(list(self.held))


class _Handle:
    def __init__(self):
        self.cells, self.timers = {}, []

    def getValueState(self, name, schema):  # noqa: N802
        return self.cells.setdefault(name, _Cell())

    def getMapState(self, name, key, value):  # noqa: N802
        return self.cells.setdefault(name, _Cell())

    def registerTimer(self, ms):  # noqa: N802
        self.timers.append(ms)


def test_pauses_cost_state_by_stretch_of_time():
    """A batch of many pauses writes one value per hour and one timer; what time has passed is judged at once."""
    hour, instants = 3_600_000_000, [n * 1_000_000 + 7 for n in range(4 * 3600)]
    judge, handle = keyed._Pauses(1800), _Handle()
    judge.init(handle)
    list(judge.handleInputRows((0,), iter([pd.DataFrame({"at": instants[::2]}), pd.DataFrame({"at": instants[1::2]})]), None))
    assert handle.cells["waiting"].writes == 4 and handle.timers == [0]
    passed = SimpleNamespace(getCurrentWatermarkInMs=lambda: 2 * hour // 1000)
    got = [at for part in judge.handleExpiredTimer((0,), passed, None) for at in part["at"]]
    want = []
    for at in instants:
        if at < 2 * hour and (not want or at - want[-1] > 1800 * 1_000_000):
            want.append(at)
    assert got == want and len(got) == 4
    # what lies within the gap is forgotten, the next one is waited for
    assert handle.timers[-1] == (want[-1] + 1801 * 1_000_000) // 1000


def test_purge_stream_does_not_recall(spark, slices):
    """A deletion acts on its own batch and on later ones; messages come out whole."""
    got = drain(keyed.purge_stream(A.with_control_rows(stream(spark, slices), "delete"), spread=3), "purged")
    messages, deletes = A.messages(spark, SF), A.deletes(spark, SF)
    want = None
    for n in range(3):
        known = purge.latest_deletes(deletes.where(F.col("seq") < (n + 1) * 334))
        part = purge.drop_purged(messages.where((F.col("seq") >= n * 334) & (F.col("seq") < (n + 1) * 334)), known)
        want = part if want is None else want.unionByName(part)
    columns = ["seq", "timestamp", "source", "entity", "flags", "track_links"]
    texts = lambda df: sorted(r[0] for r in df.select(F.to_json(F.struct(*columns))).collect())
    assert texts(got) == texts(want)
    assert 0 < got.count() > purge.drop_purged(messages, purge.latest_deletes(deletes)).count()


def test_deletions_loaded_before_the_stream(spark, slices):
    register = purge.latest_deletes(A.deletes(spark, SF))
    got = drain(keyed.purge_stream(A.with_control_rows(stream(spark, slices), "delete"), loaded=register, spread=2, carry=[]), "purged")
    batch = purge.drop_purged(A.messages(spark, SF), register)
    assert {r.seq for r in got.collect()} == {r.seq for r in batch.select("seq").collect()}


def test_inject_stream_with_loaded_inserts_equals_batch(spark, slices):
    register = inject.latest_inserts(A.inserts(spark, SF))
    got = drain(keyed.inject_stream(A.with_control_rows(stream(spark, slices), "insert"), A.NOW, loaded=register, spread=2), "injected")
    batch = inject.inject_children(A.messages(spark, SF), register, A.NOW)
    columns = ["seq", "injected_key", "model", "action", "author", "source", "entity", "timestamp"]
    texts = lambda df: sorted(r[0] for r in df.select(F.to_json(F.struct(*columns))).collect())
    assert texts(got) == texts(batch)


def test_an_insert_taken_back_reaches_no_later_message(spark):
    """The removal names the insert's key only; messages of earlier batches keep their children."""
    folder = work_path(spark, "taken-back")
    rows = A.with_control_rows(A.table(spark, SF, "events"), "insert")
    insert = rows.where("model = 'insert'").limit(1).withColumns({"seq": F.lit(1).cast("long")})
    parent, key = insert.select("insert.parent_sha256", "kafka_key").first()
    message = rows.where("model = 'binary' AND action = 'sourced'").limit(1).withColumn("entity", F.col("entity").withField("sha256", F.lit(parent)))
    message = message.withColumn("source", F.col("source").withField("path", F.slice("source.path", 1, 1)))
    removal = insert.withColumns({"seq": F.lit(3).cast("long"), "insert": F.lit(None).cast(insert.schema["insert"].dataType)})
    for part in (insert, message.withColumn("seq", F.lit(2).cast("long")), removal, message.withColumn("seq", F.lit(4).cast("long"))):
        part.coalesce(1).write.mode("append").parquet(folder)
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    got = drain(keyed.inject_stream(source, A.NOW), "injected").select("seq", "injected_key").collect()
    assert sorted((r.seq, r.injected_key or "") for r in got) == [(2, ""), (2, key), (4, "")]


def test_replay_stream_equals_batch_on_an_ordered_log(spark):
    consumer, ttl = (F.col("author.name"), F.col("author.version")), 20 * 86_400
    folder, mixed = work_path(spark, "mixed"), A.mixed(spark, SF)
    for n in range(3):
        mixed.where((F.col("seq") >= n * 334) & (F.col("seq") < (n + 1) * 334)).coalesce(1).write.mode("append").parquet(folder)
    source = spark.readStream.schema(mixed.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    got = drain(keyed.replay_stream(source, consumer, ttl, min_runtime_s=3.0, spread=3), "replayed")
    events = A.messages(spark, SF).where("action <> 'mapped'")
    statuses = replay.cacheable(A.statuses(spark, SF), 3.0)
    batch = replay.match_completions(events, statuses, consumer, ttl)
    pairs = lambda df: sorted((r.seq, r.status_id) for r in df.collect())
    assert pairs(got) == pairs(batch) != []
    results = drain(keyed.replay_stream(source, consumer, ttl, min_runtime_s=3.0, results_as_of=A.NOW), "results")
    want = replay.replay_completions(events, statuses, batch, A.NOW)[1]
    columns = ["seq", "status_id", "result_no", "source", "entity", "flags", "timestamp"]
    texts = lambda df: sorted(r[0] for r in df.select(F.to_json(F.struct(*columns))).collect())
    assert texts(results) == texts(want) != []


def test_replay_cache_expires_by_the_clock(spark):
    """A completion is forgotten a TTL after it arrived; messages ask from their own time on."""
    folder, checkpoint = work_path(spark, "expiry"), work_path(spark, "expiry-state")
    rows = A.mixed(spark, SF)
    status = rows.where("model = 'status' AND status.status = 'completed' AND status.runtime > 3").limit(1)
    sha, name, version, at = status.select("status.input.entity.sha256", "author.name", "author.version", F.unix_micros("timestamp")).first()
    message = rows.where("model = 'binary' AND NOT flags.bypass_cache").limit(1).withColumns({
        "entity": F.col("entity").withField("sha256", F.lit(sha)), "author": F.col("author").withField("name", F.lit(name)).withField("version", F.lit(version)),
        "timestamp": F.timestamp_micros(F.lit(at + 5_000_000)),
    })

    def run(part, now):
        part.coalesce(1).write.mode("append").parquet(folder)
        source = spark.readStream.schema(rows.schema).parquet(folder)
        answers = keyed.replay_stream(source, (F.col("author.name"), F.col("author.version")), 60, 3.0, now=F.timestamp_seconds(F.lit(now)), spread=1)
        return drain(answers, "expiry-out", checkpoint).count()

    assert run(status, 1000) == 0
    assert run(message, 1030) == 1
    other = status.withColumn("author", F.col("author").withField("name", F.lit("other")))
    assert run(other, 1070) == 1  # moves the clock
    assert run(message, 1080) == 1


def test_reprocess_rejects_unclear_profiles(spark):
    log = spark.createDataFrame([], schemas.TOPIC_LOG)
    old, new = Naming(), Naming(namespace="next")
    for chosen in ({}, {"upgrade_sources": True, "upgrade_system": True}):
        with pytest.raises(ValueError):
            reprocess(log, old, new, **chosen)
    with pytest.raises(ValueError):
        reprocess(log, old, new, upgrade_sources=True)


def test_reprocess_system_topics(spark):
    value = '{"author":{"name":"p"},"entity":{"status":"completed","input":{"dequeued":"d.p.1.2"}}}'
    binary = '{"author":{"name":"p"},"action":"sourced","source":{"name":"s","path":[{"sha256":"x"}]},"flags":{"expedite":true}}'
    rows = [
        ("grid.main.system.status", 0, 0, "old", value), ("grid.main.system.expedite", 0, 1, "old", binary),
        ("grid.main.system.insert", 0, 2, "old", "{}"), ("grid.main.s.binary.sourced", 0, 3, "old", binary), ("grid.main.system.status", 0, 4, "old", None),
    ]
    log = spark.createDataFrame([(*r, None) for r in rows], schemas.TOPIC_LOG)
    out = reprocess(log, Naming(), Naming(namespace="next"), upgrade_system=True, include_system=["status", "expedite"])
    got = {r.source_topic: r for r in out.collect()}
    assert set(got) == {"grid.main.system.status", "grid.main.system.expedite"}
    assert got["grid.main.system.status"].topic == "grid.next.system.status"
    assert got["grid.main.system.status"].key == spark.sql("select md5('d.p.1.2.p')").first()[0]
    assert got["grid.main.system.expedite"].topic == "grid.next.system.expedite"
