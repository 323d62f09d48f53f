"""Plans and their extension points."""

import itertools
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from builders import binary, frame, path_of, statuses
from relaygrid import schemas
from relaygrid import vocabulary as V
from relaygrid.catalog import adapter as A
from relaygrid.functions.routing import Naming, choose_topic
from relaygrid.operators import filters, inject, metrics, projections, purge
from relaygrid.operators.consumers import ConsumerSpec
from relaygrid.operators.oplog import colocate_by_key
from relaygrid.plans import consume, decode, fetch, produce, publish, reprocess
from relaygrid.session import work_path
from relaygrid.sources import batches, logs

NOW = "2024-01-31 00:00:00"


def drop_if(name, condition):
    return consume.ColumnStage(name, lambda df: F.when(condition, "no"))


def test_first_reason_wins_and_missing_stages_vanish(spark):
    df = frame(spark, [binary(), binary(), binary()])
    plan = consume.ConsumePlan([drop_if("A", F.col("seq") == 0), None, drop_if("B", F.col("seq") < 2)])
    judged = plan.run(df)
    assert [r.reason for r in judged.orderBy("seq").collect()] == ["A-no", "B-no", None]
    counts = {(r.stage, r.cause): r.removed for r in metrics.stage_counts(judged).collect()}
    assert counts == {("A", "no"): 1, ("B", "no"): 1}


def test_user_stage_as_pandas_udf(spark):
    @F.pandas_udf("string")
    def odd(seq: pd.Series) -> pd.Series:
        return seq.map(lambda n: "odd" if n % 2 else None)

    df = frame(spark, [binary() for _ in range(4)])
    judged = consume.ConsumePlan([consume.ColumnStage("Mine", lambda _: odd("seq"))]).run(df)
    assert [r.reason for r in judged.orderBy("seq").collect()] == [None, "Mine-odd", None, "Mine-odd"]


def test_later_stages_see_added_rows(spark):
    df = spark.range(3).select(F.col("id").alias("seq"))

    def add_one(rows):
        return produce.fan_out(rows, F.array(F.struct(*[
            F.lit("AddOne").alias(c) if c == "added_by" else F.col(c) for c in rows.columns])))

    def twice(rows):
        def copy(batches):
            for pdf in batches:
                yield pd.concat([pdf, pdf])

        return rows.mapInPandas(copy, rows.schema)

    ran = produce.ProducePlan([("AddOne", add_one), ("Twice", twice)]).run(df)
    assert ran.count() == 12
    assert {(r.stage, r.removed, r.added) for r in produce.produce_counts(ran).collect()} == {("AddOne", 0, 6)}


def test_results_leave_their_status(spark):
    done = {"author": {"name": "p"}, "entity": {
        "input": binary(flags={"expedite": True, "bypass_cache": True}), "status": "completed", "runtime": 1.0, "results": [binary(), binary()]}}
    failed = {"author": {"name": "p"}, "entity": {**done["entity"], "status": "failed"}}
    df = statuses(spark, [done, failed])
    for field in schemas.BINARY.fields:
        if field.name not in df.columns:
            df = df.withColumn(field.name, F.lit(None).cast(field.dataType))
    rows = produce.explode_results(df).orderBy("seq", F.desc("model")).collect()
    assert [(r.seq, r.model) for r in rows] == [(0, "status"), (0, "binary"), (0, "binary"), (1, "status")]
    assert rows[0].status.results is None and len(rows[3].status.results) == 2
    assert rows[1].flags.expedite and rows[1].flags.bypass_cache and not rows[1].flags.retry


@pytest.mark.parametrize("settings, depth, expected", [
    (None, 3, None), ({"a": "b"}, 3, {"a": "b"}), ({"remove_at_depth": "4", "a": "b"}, 3, {"remove_at_depth": "4", "a": "b"}),
    ({"remove_at_depth": "3", "a": "b"}, 3, {}), ({"remove_at_depth": "three"}, 3, {"remove_at_depth": "three"}),
])
def test_settings_removal(spark, settings, depth, expected):
    df = frame(spark, [binary(source={"name": "s", "settings": settings, "path": path_of(depth)})])
    assert projections.strip_settings_at_depth(df).first().source.settings == expected


def test_topics(spark):
    events = [
        binary(), binary(flags={"expedite": True, "retry": True}), binary(flags={"retry": True}), binary(source={"name": ""}), binary(action=None)]
    got = [r.topic for r in choose_topic(frame(spark, events)).orderBy("seq").collect()]
    assert got == ["grid.main.testing.binary.sourced", "grid.main.system.expedite", "grid.main.system.error", None, None]
    assert choose_topic(statuses(spark, [{"author": {"name": "p"}}])).first().topic == "grid.main.system.status"


def test_publish_keeps_going_past_bad_messages(spark):
    df = frame(spark, [binary(), binary(source={"name": ""}), binary(entity={"sha256": "x" * 5000})])
    done = publish.publish(publish.finalise_tracking(df), max_bytes=3000)
    assert [r.reject_reason for r in done.judged.orderBy("seq").collect()] == [None, "missing source or action", "message too large"]
    log, rejects = work_path(spark, "log"), work_path(spark, "rejects")
    publish.write_published(done, log, rejects)
    assert spark.read.parquet(log).count() == 1 and spark.read.parquet(rejects).count() == 2
    back = spark.read.parquet(log).select("topic", F.lit(0).alias("partition"), F.lit(0).cast("bigint").alias("offset"),
                                          "key", "value", F.current_timestamp().alias("ts"))
    event = fetch.decode_binary(back).first()
    assert event.entity.sha256 == "aa" and event.track_authors == [".generic."]


def test_tracking_tokens(spark):
    path = [
        {"author": {"category": "user", "name": "u", "version": "1"}, "sha256": "p"},
        {"author": {"category": "", "name": "myauthor", "version": "1.2"}, "sha256": "c", "timestamp": "2024-01-02T03:04:05Z"}]
    row = publish.finalise_tracking(frame(spark, [binary(source={"name": "s", "path": path})])).first()
    assert row.track_authors == ["user.u.1", ".myauthor.1.2"] and row.track_links == ["p.c.2024_01_02T03_04_05Z_00..myauthor.1.2"]


def test_fetch_from_a_log(spark):
    """Expedite before live before historic; tombstones and nonsense are skipped."""
    spec = ConsumerSpec("me", "1", count=3, is_task=True, require_expedite=True, require_historic=True, require_sources=["testing"])
    made = [
        binary(kafka_key=f"k{i}", flags={"expedite": i == 5, "bypass_cache": False, "retry": False},
               source={"name": "other" if i == 1 else "testing", "path": path_of(1)}) for i in range(8)]
    routed = publish.publish(frame(spark, made)).routed
    value = F.when(F.col("seq") == 2, None).when(F.col("seq") == 3, "{nonsense").otherwise(F.col("value"))
    log = routed.select("topic", F.lit(0).alias("partition"), F.col("seq").alias("offset"), F.col("kafka_key").alias("key"),
                        value.alias("value"), F.timestamp_seconds("seq").alias("ts"))
    progress = [("grid-key-expedite", "grid.main.system.expedite", 0, 0), ("grid-key-live", "grid.main.testing.binary.sourced", 0, 7)]
    offsets = spark.createDataFrame(progress, schemas.OFFSETS)
    candidates = fetch.decode_binary(fetch.deliveries(log, offsets, "key", spec))
    got = fetch.fetch(candidates, spec, consume.ConsumeContext(now=NOW, dedupe=True, row_id="delivery"), ["delivery"])
    rows = got.delivered.collect()
    assert [(r.feed, r.kafka_key) for r in rows] == [("expedite", "k5"), ("live", "k7"), ("historic", "k0")]
    assert rows[0].dequeued == "k5.me.1.1706659200"
    info = got.info().first()
    # k7 comes again on the historic feed, but beyond the last message handed out
    assert info.filters == {} and info.fetched == 3 and info.ready and not info.paused
    start = got.task_starts().first()
    assert start.entity.features == [] and start.entity.datastreams == []


def backlog(spark, rows, wanted):
    """``rows`` messages, of which every ``wanted``-th is of the source a consumer wants."""
    one = frame(spark, [binary(source={"name": "other", "path": path_of(1)})]).drop("seq")
    many = spark.range(rows).withColumnRenamed("id", "seq").join(one.withColumn("_one", F.lit(0)), F.col("seq") * 0 == F.col("_one")).drop("_one")
    name = F.when(F.col("seq") % wanted == wanted - 1, "mine").otherwise("other")
    return many.withColumns({"kafka_key": F.concat(F.lit("k"), "seq"), "source": F.col("source").withField("name", name)})


def test_fetch_judges_no_more_than_it_needs(spark):
    """10 of 20,000: one window; where few pass, windows grow until the answer is full."""
    df, ctx = backlog(spark, 20_000, 400), consume.ConsumeContext(now=NOW)
    easy = fetch.fetch(df, ConsumerSpec("me", "1", count=10), ctx, ["seq"])
    assert [r.seq for r in easy.delivered.collect()] == list(range(10))
    assert easy.judged.count() == 80 and easy.info().first().fetched == 10 and easy.position.seq == 9
    hard = fetch.fetch(df, ConsumerSpec("me", "1", count=10, require_sources=["mine"]), ctx, ["seq"])
    assert [r.seq for r in hard.delivered.collect()] == [400 * i + 399 for i in range(10)]
    info = hard.info().first()
    # 80, 640, 5120: the last window holds the tenth
    assert hard.judged.count() == 5120 and info.fetched == 10 and sum(info.filters.values()) == 3990


def test_fetch_goes_on_where_it_stopped(spark):
    """The rows of fetches in a row are those of one fetch; the last one says that nothing is left."""
    df, ctx, spec = backlog(spark, 3000, 100), consume.ConsumeContext(now=NOW), ConsumerSpec("me", "1", count=7, require_sources=["mine"])
    seen, counted, at = [], 0, None
    while True:
        got = fetch.fetch(df, spec, ctx, ["seq"], after=at)
        seen += [r.seq for r in got.delivered.collect()]
        info = got.info().first()
        counted += info.fetched + sum(info.filters.values())
        at = got.position
        if at is None:
            break
    assert seen == [100 * i + 99 for i in range(30)] and counted == 3000


def test_fetch_spends_its_deadline(spark):
    """With a budget of 2 s at 150 rows, 300 rows are examined, and the position lies behind them."""
    df, ctx = backlog(spark, 3000, 100), consume.ConsumeContext(now=NOW)
    spec = ConsumerSpec("me", "1", count=7, deadline=2, require_sources=["mine"])
    got = fetch.fetch(df, spec, ctx, ["seq"], rows_per_s=150)
    info = got.info().first()
    assert [r.seq for r in got.delivered.collect()] == [99, 199, 299]
    assert info.fetched == 3 and sum(info.filters.values()) == 297 and got.position.seq == 299
    patient = fetch.fetch(df, ConsumerSpec("me", "1", count=7, deadline=0, require_sources=["mine"]), ctx, ["seq"], rows_per_s=1)
    assert patient.delivered.count() == 7


def test_paused_consumer_gets_nothing(spark):
    df = frame(spark, [binary(kafka_key=f"k{i}") for i in range(4)])
    got = fetch.fetch(df, ConsumerSpec("me", "1", count=2), consume.ConsumeContext(now=NOW), ["seq"], gate="paused")
    info = got.info().first()
    assert got.delivered.isEmpty() and info.paused and not info.ready and info.fetched == 0


def test_scan_opens_only_the_topics_of_the_feeds(spark):
    path = work_path(spark, "by-topic")
    rows = [(f"grid.main.{s}.binary.sourced", 0, i, "k", "{}", None) for i, s in enumerate(["a", "b", "c"] * 3)]
    logs.write_topic_log(spark.createDataFrame(rows, schemas.TOPIC_LOG), path)
    spec = ConsumerSpec("me", "1", require_historic=True, require_sources=["b"])
    offsets = spark.createDataFrame([], schemas.OFFSETS)
    found = fetch.deliveries(logs.read_topic_log(spark, path), offsets, "key", spec)
    assert found.count() == 3
    scans = [x for x in found._jdf.queryExecution().executedPlan().toString().splitlines() if "PartitionFilters" in x and "by-topic" in x]
    assert scans and all("RLIKE" in x for x in scans)


HEADER = {"model_version": 6, "kafka_key": "old", "timestamp": "2024-01-10T00:00:00.123456Z", "author": {"name": "a", "version": "1", "category": "plugin"}}
MODELS = {
    "binary": binary(kafka_key="old", dequeued="d", retries=2),
    "status": {**HEADER, "entity": {"input": binary(dequeued="k.me.1"), "status": "completed", "runtime": 2.5, "results": [binary()]}},
    "plugin": {**HEADER, "entity": {"name": "p", "version": "2", "config": {"x": "y"}}},
    "insert": {**HEADER, "entity": {"original_source": "s", "parent_sha256": "sha2561", "child": {"sha256": "sha2562"},
               "child_history": {"author": {"name": "myauthor", "version": "1.2"}}}},
    "delete": {**HEADER, "action": "link", "entity": {"reason": "r", "link": {"track_link": "t"}}},
    "download": {**HEADER, "action": "fetch", "source": {"name": "s", "timestamp": "2024-01-10T00:00:00+02:00"}, "entity": {"hash": "h", "category_quota": 3}},
}


def as_log(spark, values, topic):
    rows = [(topic, 0, i, "old", v, None) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, schemas.TOPIC_LOG)


@pytest.mark.parametrize("model", MODELS)
def test_every_model_reads_back_what_it_wrote(spark, model):
    log = as_log(spark, [json.dumps(MODELS[model])], "t")
    once = decode.decode_messages(log, F.lit(model))
    again = decode.decode_messages(once.drop("value").withColumn("value", publish.encode(once)).select(*log.columns), F.lit(model))
    first, second = (df.drop("value").first().asDict(True) for df in (once, again))
    assert first == second and first["kafka_key"] == "old"
    assert model == "binary" or first[model] is not None


@pytest.mark.parametrize("model", MODELS)
def test_reprocess_changes_the_key_in_the_row_and_the_value(spark, model):
    values = [json.dumps(MODELS[model]), "{broken", json.dumps({**MODELS[model], "timestamp": [1]}), json.dumps(MODELS[model]) + " {}"]
    system = model != "binary"
    topic = f"grid.main.system.{model}" if system else "grid.main.testing.binary.sourced"
    moved = reprocess.reprocess(as_log(spark, values, topic), Naming(), Naming(namespace="next"), not system, system, (model,))
    row = moved.collect()
    assert len(row) == 1 and row[0].key and row[0].key != "old"
    new, old = json.loads(row[0].value), MODELS[model]
    assert new["kafka_key"] == row[0].key and new["author"] == old["author"]
    if model == "status":
        assert new["entity"]["input"]["kafka_key"] == "k1" and len(new["entity"]["results"]) == 1
    if model == "insert":
        assert new["track_author"] == ".myauthor.1.2" and new["track_link"] == "sha2561.sha2562.0001_01_01T00_00_00Z_00..myauthor.1.2"


@pytest.mark.parametrize("written", ["2024-01-01T05:00:00+11:00", "2024-01-01T05:00:00.123456789-03:30", "2024-01-01T05:00:00Z"])
def test_identity_follows_the_written_clock(spark, written):
    event = binary(source={"name": "s", "timestamp": written, "path": path_of(1)})
    plain = binary(source={"name": "s", "timestamp": "2024-01-01T05:00:00Z", "path": path_of(1)})
    keys = []
    for e in (event, plain):
        moved = reprocess.reprocess(as_log(spark, [json.dumps(e)], "grid.main.s.binary.sourced"), Naming(), Naming(namespace="next"), True).first()
        keys.append(moved.key)
        assert json.loads(moved.value)["source"]["timestamp"] == e["source"]["timestamp"]
    parsed = batches.parse_event_batches(spark.createDataFrame([("b", json.dumps(event))], "batch_id string, body string"), "binary")
    rows = parsed.messages("binary")
    published = produce.survivors(produce.publish_plan(NOW).run(rows.withColumn("seq", F.lit(0).cast("long")))).first()
    assert keys[0] == keys[1] == published.kafka_key


def test_a_deletion_by_link_hits_a_published_message(spark):
    path = path_of(2, timestamp="2024-01-02T03:04:05Z", author={"name": "me", "version": "1", "category": "plugin"})
    out = publish.publish(frame(spark, [binary(source={"name": "s", "path": path}), binary()])).routed
    log = out.select("topic", F.lit(0).alias("partition"), F.col("seq").alias("offset"), F.col("kafka_key").alias("key"), "value", F.current_timestamp().alias("ts"))
    back = fetch.decode_binary(log).withColumn("seq", F.col("offset"))
    deletion = frame(spark, [{"action": "link", "entity": {"link": {"track_link": "s0.s1.2024_01_02T03_04_05Z_00.plugin.me.1"}}}], schemas.DELETE, "delete")
    judged = purge.judge_purged(back, purge.settle_register(deletion))
    assert {r.seq: r.purged for r in judged.collect()} == {0: True, 1: False}


@pytest.mark.parametrize("order", list(itertools.permutations(["ageoff", "deep", "deleted", "repeat"])))
def test_stages_in_any_order_and_all_models(spark, order):
    """Brute-force fold over mixed binaries and statuses."""
    made = [binary(kafka_key=f"k{i % 4}", source={"name": "old" if i % 3 == 0 else "new", "timestamp": "2024-01-01T00:00:00Z", "path": path_of(3 if i % 5 == 0 else 1)},
                   flags={"expedite": i % 7 == 0}) for i in range(24)]
    rows = frame(spark, made).withColumn("status", F.lit(None).cast(schemas.STATUS_ENTITY))
    states = statuses(spark, [{"author": {"name": "p"}, "entity": {"input": e, "status": "completed"}} for e in made[:6]]).withColumn("seq", F.col("seq") + 100)
    df = rows.unionByName(states, allowMissingColumns=True)
    deletion = frame(spark, [{"action": "ids", "entity": {"ids": {"ids": ["k2"]}}}], schemas.DELETE, "delete")
    sources = spark.createDataFrame([("old", 86_400_000)], schemas.SOURCES)
    stages = {
        "ageoff": consume.ageoff_stage(sources, NOW), "deep": consume.depth_stage(2),
        "deleted": consume.deleted_stage(purge.settle_register(deletion)), "repeat": consume.duplicates_stage(True),
    }
    got = {r.seq: r.reason for r in consume.ConsumePlan([stages[n] for n in order]).run(df).collect()}
    alone = {n: {r.seq: r.reason for r in consume.ConsumePlan([stages[n]]).run(df).collect()} for n in ("ageoff", "deep")}
    want, seen = {}, set()
    for name in order:
        for seq in sorted(got):
            binary_row = seq < 100
            if want.get(seq):
                continue
            if name in alone:
                want[seq] = alone[name][seq]
            elif name == "deleted":
                want[seq] = "FilterPreviouslyDeleted-deleted" if binary_row and seq % 4 == 2 else None
            elif binary_row and seq % 7 and f"k{seq % 4}" in seen:
                want[seq] = "FilterDuplicates-skipped"
            elif binary_row and seq % 7:
                seen.add(f"k{seq % 4}")
    assert got == {seq: want.get(seq) for seq in got}


def test_inserts_without_a_key_do_not_multiply_parents(spark):
    register = inject.latest_inserts(frame(spark, [
        {"kafka_key": k, "entity": {"parent_sha256": "aa", "child": {"sha256": f"c{k}"}, "child_history": {"action": "extracted"}}} for k in (None, "i1", None)
    ], schemas.INSERT, "insert").withColumnRenamed("entity", "insert"))
    out = inject.inject_children(frame(spark, [binary() for _ in range(5)]), register, NOW)
    assert out.where("injected_key is null").count() == 5 and out.count() == 10


def test_missing_key_is_not_handed_out(spark):
    df = frame(spark, [binary(kafka_key="")])
    for task, reason in ((True, "RaiseDequeuedStatus-error_no_id"), (False, None)):
        spec = ConsumerSpec("me", is_task=task)
        assert consume.ConsumePlan([consume.dequeued_stage(spec)]).run(df).first().reason == reason


def test_simulation_ignores_state(spark):
    df = frame(spark, [binary(source={"name": "s", "path": path_of(11)}), binary(source={"name": "s", "path": path_of(12)})])
    judged = consume.simulate_plan(ConsumerSpec("me")).run(df).orderBy("seq").collect()
    assert [r.reason for r in judged] == [None, "FilterTooDeep-too_deep"]


def test_log_files(spark, tmp_path):
    (tmp_path / "access.log").write_text('{"time":"t","duration_s":"0.5","status":404,"method":"GET","route":"r"}\n')
    row = logs.read_access_log(spark, str(tmp_path / "access.log")).first()
    assert (row.status, row.duration_s) == (404, "0.5")
    (tmp_path / "blob.bin").write_bytes(b"abc")
    blob = logs.read_blobs(spark, str(tmp_path), "s", "content", "*.bin").first()
    assert bytes(blob.data) == b"abc" and blob.label == "content"


def test_same_key_same_partition(spark):
    df = frame(spark, [binary(kafka_key=f"k{i % 5}") for i in range(40)])
    placed = colocate_by_key(df, 3).select("kafka_key", F.spark_partition_id().alias("p")).distinct()
    assert placed.count() == 5


def test_naming_is_a_parameter():
    assert Naming("a", "b").system("status") == "a.b.system.status"


def test_undecodable_rows_are_skipped(spark):
    log = spark.createDataFrame([('{"size":1}',), ("{broken",), ('{"size":"x"}',)], "value string")
    kept = filters.drop_undecodable(log, schemas.struct(size=schemas.LONG)).collect()
    assert [r.event.size for r in kept] == [1]


def test_settings_are_stripped_before_deletions_are_looked_up():
    """The lookup joins by id; what it need not carry does not pass it."""
    names = [name for name, _ in produce.publish_plan(NOW, deletes=object()).stages]
    assert names.index(V.STAGE_SETTINGS) < names.index(V.STAGE_DELETED)


def test_messages_beside_flat_columns_equal_the_join(spark):
    sf = "/root/testdata/sf0.001"
    columns = ["seq", "k", "depth", "kafka_key", "source", "entity"]
    want = A.messages(spark, sf).join(A.scalars(spark, sf).select("seq", "k", "depth"), "seq").select(*columns)
    got = A.messages_beside(spark, sf, ["k", "depth"]).select(*columns)
    texts = lambda df: sorted(r[0] for r in df.select(F.to_json(F.struct(*columns))).collect())
    assert texts(got) == texts(want) != []
