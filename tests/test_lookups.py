"""Deletions, inserts, replays, repeats, tasks and pauses on small cases."""

import random

import pytest
from pyspark.sql import functions as F

from builders import binary, frame, path_of, statuses
from relaygrid import schemas, vocabulary as V
from relaygrid.operators import consumers, dedupe, inject, oplog, pause, purge, replay, tasks
from relaygrid.operators.consumers import ConsumerSpec
from relaygrid.plans import produce

NOW = "2024-01-31 00:00:00"


def deletes(spark, *entities):
    rows = [{"action": action, "entity": {key: value}} for action, key, value in entities]
    return frame(spark, rows, schemas.DELETE, "delete")


def purged(spark, events, *entities):
    df = frame(spark, events)
    judged = purge.judge_purged(df, purge.settle_register(deletes(spark, *entities)))
    return [r.seq for r in judged.where("purged").orderBy("seq").collect()]


def test_purge_kinds(spark):
    events = [
        binary(kafka_key="gone"), binary(track_links=["a", "l1"]), binary(track_authors=["p.x.1"]),
        binary(track_source_references="ref1"), binary(kafka_key="fine", track_links=["b"], track_authors=["p.y.1"]),
    ]
    assert purged(spark, events, ("ids", "ids", {"ids": ["gone", "other"]})) == [0]
    assert purged(spark, events, ("link", "link", {"track_link": "l1"})) == [1]
    assert purged(spark, events, ("submission", "submission", {"track_source_references": "ref1"})) == [3]


def test_author_deletion_spares_later_messages(spark):
    events = [binary(track_authors=["p.x.1"], timestamp=f"2024-01-{d:02d}T00:00:00Z") for d in (9, 10, 11)]
    deletion = ("author", "author", {"track_author": "p.x.1", "timestamp": "2024-01-10T00:00:00Z"})
    assert purged(spark, events, deletion) == [0]
    earlier = ("author", "author", {"track_author": "p.x.1", "timestamp": "2024-01-02T00:00:00Z"})
    # the deletion that arrived last counts, not the one with the later time
    assert purged(spark, events, deletion, earlier) == []


def test_submission_deletion_with_time(spark):
    events = [
        binary(track_source_references="r", source={"name": "s", "timestamp": f"2024-01-{d:02d}T00:00:00Z"}) for d in (1, 2)
    ]
    assert purged(spark, events, ("submission", "submission", {"track_source_references": "r", "timestamp": "2024-01-02T00:00:00Z"})) == [1]


def insert(parent, child, key, author="user"):
    return {
        "kafka_key": key, "entity": {
            "parent_sha256": parent, "child": {"sha256": child},
            "child_history": {"author": {"name": author}, "action": "extracted", "sha256": child},
        },
    }


def children(spark, parents, inserts):
    rows = frame(spark, inserts, schemas.INSERT, "insert").withColumnRenamed("entity", "insert")
    out = inject.inject_children(frame(spark, parents), inject.settle_register(rows), NOW)
    assert out.where("injected_key IS NULL").count() == len(parents)
    return out.where("injected_key IS NOT NULL")


@pytest.mark.parametrize("inserts, count", [
    ([], 0), ([insert("zz", "c1", "k1")], 0), ([insert("aa", "c1", "k1")], 1),
    ([insert("aa", "c1", "k1"), insert("aa", "c2", "k2")], 2),
    ([insert("aa", "c1", "k1"), insert("aa", "c1", "k1")], 1),
    ([insert("aa", "c1", "k1", "old"), insert("aa", "c1", "k1", "new")], 1),
])
def test_inject(spark, inserts, count):
    rows = children(spark, [binary()], inserts).collect()
    assert len(rows) == count
    for row in rows:
        assert row.source.path[-1].sha256 == row.entity.sha256 and len(row.source.path) == 2
        assert row.source.name == "testing" and row.action == "extracted" and row.kafka_key is None
    if inserts and inserts[-1]["entity"]["child_history"]["author"]["name"] == "new":
        assert rows[0].author.name == "new"


@pytest.mark.parametrize("action, path, expected", [
    ("enriched", path_of(3), False), ("mapped", path_of(3), False), ("extracted", path_of(3), True), ("sourced", path_of(1), True),
    ("augmented", path_of(3, sha256="s1"), False), ("sourced", [], True),
])
def test_injectable(spark, action, path, expected):
    df = frame(spark, [binary(action=action, source={"name": "s", "path": path})])
    assert df.select(inject.injectable(df).alias("i")).first().i is expected


def completion(sha, name="plug1", version="1", day=10, results=1, runtime=20.0, status="completed"):
    found = [binary(entity={"sha256": f"r{i}"}, flags={"bypass_cache": True}) for i in range(results)]
    return {
        "timestamp": f"2024-01-{day:02d}T00:00:00Z", "author": {"name": name, "version": version},
        "entity": {"input": binary(entity={"sha256": sha}, source={"name": "old", "path": path_of(2)}),
                   "status": status, "runtime": runtime, "results": found},
    }


def test_replay(spark):
    stats = statuses(spark, [
        completion("b1"), completion("b2", name="plug2"), completion("b3", version="2"), completion("b4", results=0),
        completion("b5", runtime=10.0), completion("b6", status="failed"), completion("b7", day=1), completion("b8", day=12),
        completion("b9", day=9), completion("b9", day=10, results=2), completion("b9", day=8, results=3),
    ])
    events = [binary(entity={"sha256": f"b{i}"}, timestamp="2024-01-11T00:00:00Z", flags={"expedite": True}) for i in range(1, 10)]
    events.append(binary(entity={"sha256": "b1"}, timestamp="2024-01-11T00:00:00Z", flags={"bypass_cache": True}))
    df, cached = frame(spark, events), replay.cacheable(stats)
    matches = replay.match_completions(df, cached, (F.lit("plug1"), F.lit("1")), ttl_s=5 * 86_400)
    # no results is still a hit; too old, too new, too quick, failed and foreign ones are not
    assert {r.seq: r.status_id for r in matches.collect()} == {0: 0, 3: 3, 8: 9}
    flagged, replayed = replay.replay_completions(df, cached, matches, NOW)
    assert {r.seq for r in flagged.where("replay_reason = 'cached'").collect()} == {0, 3, 8}
    rows = replayed.orderBy("seq", "result_no").collect()
    assert [(r.seq, r.entity.sha256) for r in rows] == [(0, "r0"), (8, "r0"), (8, "r1")]
    first = rows[0]
    assert first.source.name == "testing" and [n.sha256 for n in first.source.path] == ["aa", "s1"]
    assert first.flags.expedite and not first.flags.bypass_cache and str(first.timestamp) == NOW
    assert first.source.path[-1].timestamp == first.timestamp


def test_replay_with_one_hot_entity_matches_brute_force(spark):
    rng = random.Random(1)
    events = [(i, rng.choice(["hot"] * 4 + ["a", "b"]), rng.randrange(5000), rng.random() < .3) for i in range(600)]
    rows = spark.createDataFrame(events, "seq bigint, sha string, s int, done boolean").select(
        "seq", F.when(F.col("done"), "status").otherwise("binary").alias("model"), F.timestamp_seconds("s").alias("timestamp"),
        F.struct(F.lit("p").alias("name"), F.lit("1").alias("version")).alias("author"),
        F.struct(F.col("sha").alias("sha256")).alias("entity"), F.struct(F.lit(False).alias("bypass_cache")).alias("flags"),
        F.struct(F.struct(F.struct(F.col("sha").alias("sha256")).alias("entity")).alias("input")).alias("status"))
    got = replay.match_completions(
        rows.where("model = 'binary'"), rows.where("model = 'status'"), (F.lit("p"), F.lit("1")), ttl_s=60)
    want = {}
    for i, sha, s, done in events:
        if not done:
            hits = [(t, j) for j, other, t, d in events if d and other == sha and s - 60 < t <= s]
            if hits:
                want[i] = max(hits)[1]
    assert {r.seq: r.status_id for r in got.collect()} == want


def test_first_seen_sequence(spark):
    events = [
        binary(), binary(), binary(kafka_key="k2"), binary(flags={"expedite": True}), binary(flags={"bypass_cache": True}),
        binary(kafka_key=""), binary(),
    ]
    df = frame(spark, events).withColumn("consumer", F.when(F.col("seq") == 6, "other").otherwise("one"))
    got = [r.dedupe_reason for r in dedupe.first_seen(df, ["consumer"]).orderBy("seq").collect()]
    assert got == [None, V.DUPLICATE, None, None, None, V.DUPLICATE_NO_KEY, None]


@pytest.mark.parametrize("size, slots", [(0, 1), (1, 1), (8, 1), (9, 2), (1000, 128), (1024, 128), (1025, 256)])
def test_slot_count(size, slots):
    assert dedupe.slot_count(size) == slots


@pytest.mark.parametrize("rows_per_split", [7, 100_000])
def test_bounded_first_seen_matches_a_table(spark, rows_per_split):
    rng = random.Random(2)
    keys = [rng.choice(["hot"] * 10 + [f"k{i}" for i in range(30)]) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(keys)), "seq bigint, kafka_key string").withColumn("h", F.xxhash64("kafka_key"))
    table, want = {}, []
    for row in df.orderBy("seq").collect():
        slot = row.h & 7
        want.append((table.get(slot, 0) == row.h, table.get(slot, 0) not in (0, row.h)))
        table[slot] = row.h
    flagged = dedupe.bounded_first_seen(df, 64, rows_per_split=rows_per_split).orderBy("seq").collect()
    assert [(r.is_repeat, r.is_collision) for r in flagged] == want
    empty_slot = dedupe.bounded_first_seen(df.where("seq < 1"), 64, F.lit(0).cast("bigint"))
    assert empty_slot.first().is_repeat  # hash 0 looks seen in an empty slot


def test_lost_tasks(spark):
    epoch = 1_706_659_200  # NOW
    ids = ["k.p.1.1", f"k.p.1.{epoch - 1801}", f"k2.p.1.{epoch - 1801}", f"k.p.1.{epoch - 1800}", f"k.p.1.{epoch + 100}", f"k.p.1.{epoch - 3600}"]
    starts = frame(spark, [binary(dequeued=i) for i in ids])
    done = frame(spark, [{"entity": {"status": s, "input": binary(dequeued=ids[2])}} for s in ("heartbeat", "completed")], schemas.STATUS, "status")
    lost = tasks.lost_tasks(starts, tasks.finished_ids(done.withColumnRenamed("entity", "status")), NOW)
    found = tasks.lost_task_statuses(lost, NOW).collect()
    assert [(r.status.status, r.status.error) for r in found] == [("error-network", f"lost task: {ids[1]}")]
    assert found[0].author.name == "generic" and found[0].status.input.dequeued == ids[1]
    keyed = produce.survivors(produce.rekey_plan().run(tasks.lost_task_statuses(lost, NOW).withColumn("seq", F.lit(0))))
    assert keyed.first().kafka_key == spark.sql(f"select md5('{ids[1]}.generic')").first()[0]
    only_heartbeat = tasks.finished_ids(done.withColumnRenamed("entity", "status").where("seq = 0"))
    assert tasks.lost_tasks(starts, only_heartbeat, NOW).count() == 2


def test_pause_gate_matches_brute_force(spark):
    rng = random.Random(3)
    pauses = [rng.randrange(40_000) * 1000 + rng.randrange(1000) for _ in range(12)] + [600_000, 600_000]
    asked = [rng.randrange(40_000) * 1000 for _ in range(400)] + [p + d for p in pauses for d in (-1, 0, 1, 600_000, 599_999, 1_800_000, 1_799_999)]
    p = spark.createDataFrame([(x,) for x in pauses], "ms bigint").select(F.timestamp_millis("ms").alias("paused_at"))
    q = spark.createDataFrame([(i, x, True) for i, x in enumerate(asked)], "seq int, ms bigint, is_task boolean").select(
        "seq", F.timestamp_millis("ms").alias("requested_at"), "is_task")

    def gate(t):
        ages = [t - x for x in pauses if x <= t]
        last = min(ages, default=None)
        return "normal" if last is None or last >= 1_800_000 else "paused" if last < 600_000 else "latest"

    got = {r.seq: r.gate for r in pause.pause_gate(q, p).collect()}
    assert got == {i: gate(t) for i, t in enumerate(asked)}
    other = pause.pause_gate(q.withColumn("is_task", F.lit(False)), p)
    assert {r.gate for r in other.collect()} == {"normal"}


@pytest.mark.parametrize("seed, spread", [(4, 400), (5, 3000), (6, 60_000)])
def test_throttled_pauses_match_a_fold(spark, seed, spread):
    rng = random.Random(seed)
    seconds = [rng.randrange(spread) for _ in range(60)]
    df = spark.createDataFrame([(s,) for s in seconds], "s bigint").select(F.timestamp_seconds("s").alias("paused_at"))
    kept, last = [], None
    for s in sorted(seconds):
        if last is None or s - last > 60:
            kept.append(s)
            last = s
    got = pause.throttled_pauses(df).select(F.unix_seconds("paused_at").alias("s"))
    assert sorted(r.s for r in got.collect()) == kept


@pytest.mark.parametrize("per_block", [1, 500])
def test_match_matrix(spark, per_block):
    specs = [
        ConsumerSpec("small", require_under_content_size=10), ConsumerSpec("exe", require_streams={"content": ["executable/"]}),
        ConsumerSpec("any"),
    ]
    table = spark.range(1).select(F.explode(F.array(*[s.column() for s in specs])).alias("s")).select("s.*")
    events = frame(spark, [binary(), binary(source={"name": "s", "path": path_of(12)})])
    got = consumers.consumer_match_matrix(events, table, ["seq"], per_block=per_block).collect()
    assert {(r.seq, r.consumer_name): r.filter_out_trigger for r in got} == {
        (0, "small"): "FilterConsumerRules-reject_content_too_large", (0, "exe"): "FilterConsumerRules-reject_file_format", (0, "any"): None,
        (1, "small"): "FilterTooDeep-too_deep", (1, "exe"): "FilterTooDeep-too_deep", (1, "any"): "FilterTooDeep-too_deep"}
    assert all(r.filter_out == (r.filter_out_trigger is not None) for r in got)


def test_pages_continue(spark):
    log = spark.createDataFrame(
        [("t", i % 2, i // 2, f"k{i}", "v", i) for i in range(25)], "topic string, partition int, offset bigint, key string, value string, s int"
    ).withColumn("ts", F.timestamp_seconds("s")).drop("s")
    offsets = spark.createDataFrame([], schemas.OFFSETS)
    seen = []
    for _ in range(4):
        rows, offsets = oplog.page(log, offsets, "g", 10)
        seen += [r.key for r in rows.orderBy("ts").collect()]
    assert seen == [f"k{i}" for i in range(25)]
    with pytest.raises(ValueError):
        oplog.resume_scan(log, offsets, "middle", "g")
