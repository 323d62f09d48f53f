"""Whole plans over the given tables, and the streaming operators."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relaygrid import schemas
from relaygrid import vocabulary as V
from relaygrid.catalog import adapter as A
from relaygrid.catalog.lookups import DELETES_SQL, INSERTS_SQL, REPLAY_SQL, REPLAY_TTL, THROTTLED_SQL
from relaygrid.catalog.registry import query
from relaygrid.catalog.rows import AGEOFF_SQL, KEY_SQL, PATH_SQL, source_log
from relaygrid.functions.routing import Naming
from relaygrid.operators import inject, layout, purge, replay
from relaygrid.operators.consumers import ConsumerSpec
from relaygrid.plans import fetch as FE
from relaygrid.plans import produce
from relaygrid.plans.consume import ConsumeContext, ConsumePlan, active_plan, ageoff_stage, deleted_stage, depth_stage, passive_plan
from relaygrid.plans.reprocess import reprocess
from relaygrid.session import work_path
from relaygrid.streaming import keyed, stateful

FETCH_SPEC = ConsumerSpec(
    name="plugin3", version="v1", is_task=True, count=60, require_sources=["src0", "src1", "src2", "src3"],
    deny_events=["mapped"], deny_self=True, require_under_content_size=2500, max_security="MEDIUM",
    require_expedite=True, require_live=True, require_historic=True,
)

# The plan of FETCH_SPEC stage by stage: r5 ends the row rules and deletions,
# r6 adds repeats, r7 replays, r8 missing ids.
PLAN_SQL = DELETES_SQL.strip() + """,
r5 AS (
  SELECT *, CASE
      WHEN source_ts + to_days(CAST(CASE source_name WHEN 'src0' THEN 20 WHEN 'src1' THEN 10 WHEN 'src2' THEN 10 END AS INT))
        < TIMESTAMP '2024-01-31 00:00:00' THEN 'PipelineAgeoff-ageoff'
      WHEN depth > {depth} THEN 'FilterTooDeep-too_deep'
      WHEN security = 'HIGH MOD1' THEN 'FilterSecurity-max_security'
      WHEN source_name = 'src4' THEN 'FilterConsumerRules-reject_source'
      WHEN action = 'mapped' THEN 'FilterConsumerRules-reject_event_type'
      WHEN author_name = 'plugin3' THEN 'FilterConsumerRules-reject_self'
      WHEN k % 6 <> 0 AND size > 2500 THEN 'FilterConsumerRules-reject_content_too_large'
      WHEN k % 6 = 0 THEN 'FilterConsumerRules-reject_no_content'
      WHEN by_id OR by_link OR by_author OR by_submission THEN 'FilterPreviouslyDeleted-deleted' END AS reason5
  FROM judged),
r6 AS (
  SELECT *, coalesce(reason5, CASE WHEN bypass OR expedite THEN NULL WHEN kafka_key = '' THEN 'FilterDuplicates-error'
      WHEN row_number() OVER (PARTITION BY kafka_key, reason5 IS NULL AND NOT (bypass OR expedite) ORDER BY seq) > 1 THEN 'FilterDuplicates-skipped' END) AS reason6
  FROM r5),
r7 AS (
  SELECT *, coalesce(reason6, CASE WHEN NOT bypass AND EXISTS (
      SELECT 1 FROM ev s WHERE s.event_type = 'purchase' AND s.status = 'completed' AND s.value / 10 > 3 AND s.author_name = 'plugin3'
        AND s.author_version = 'v1' AND s.sha256 = r6.sha256 AND s.ts <= r6.ts AND s.ts > r6.ts - INTERVAL 2 DAY) THEN 'ReplayPluginCompletion-cached' END) AS reason7
  FROM r6),
r8 AS (SELECT *, coalesce(reason7, CASE WHEN kafka_key = '' THEN 'RaiseDequeuedStatus-error_no_id' END) AS reason8 FROM r7)
"""
ACTIVE_SQL = PLAN_SQL.replace("{depth}", "10")
PASSIVE_SQL = PLAN_SQL.replace("{depth}", "11")


# Candidates up to the last message handed out; all, if the answer is not full.
EXAMINED_SQL = """
ordered AS (SELECT seq, reason8, count(*) FILTER (reason8 IS NULL) OVER (ORDER BY ts, seq) AS handed FROM r8),
examined AS (SELECT seq FROM ordered WHERE handed < 60 OR (handed = 60 AND reason8 IS NULL))
"""


def _context(spark, sf, active: bool) -> ConsumeContext:
    cached = replay.cacheable(A.statuses(spark, sf), min_runtime_s=3.0)
    return ConsumeContext(
        now=A.NOW, sources=A.sources(spark), scheme=A.SCHEME, deletes=purge.settle_register(A.deletes(spark, sf)),
        dedupe=True, statuses=cached if active else None, replay_ttl_s=2 * 86_400,
    )


def _fetched(spark, sf) -> FE.Fetched:
    return FE.fetch(A.messages(spark, sf), FETCH_SPEC, _context(spark, sf, True), ["timestamp", "seq"])


@query("fetch_active", A.sql("""
    SELECT seq, action, source_name, kafka_key || '.plugin3.v1.1706659200' AS dequeued FROM r8 WHERE reason8 IS NULL ORDER BY ts, seq LIMIT 60""", ACTIVE_SQL))
def _fetch_active(spark, sf):
    return _fetched(spark, sf).delivered.select("seq", "action", F.col("source.name").alias("source_name"), "dequeued")


@query("consume_active", A.sql("SELECT seq, reason8 AS reason FROM r8", ACTIVE_SQL))
def _consume_active(spark, sf):
    return active_plan(FETCH_SPEC, _context(spark, sf, True)).run(A.messages(spark, sf)).select("seq", "reason")


@query("fetch_active_info", A.sql("""
    SELECT coalesce(reason8, 'fetched') AS reason, count(*) AS n FROM r8 JOIN examined USING (seq) GROUP BY ALL""", ACTIVE_SQL, EXAMINED_SQL))
def _fetch_active_info(spark, sf):
    info = _fetched(spark, sf).info()
    both = F.map_concat("filters", F.create_map(F.lit("fetched"), F.col("fetched").cast("bigint")))
    return info.select(F.explode(both).alias("reason", "n"))


def _long_memory(sql: str) -> str:
    """The same plan for a consumer that takes its own results, with a cache of 40 days and any runtime, and 1000 messages at most."""
    sql = sql.replace("WHEN author_name = 'plugin3' THEN", "WHEN false THEN")
    return sql.replace("INTERVAL 2 DAY", "INTERVAL 40 DAY").replace("s.value / 10 > 3", "s.value / 10 > 0").replace("60", "1000")


@query("fetch_replayed", A.sql(_long_memory("""
    SELECT x.seq, s.seq AS status_id, CAST(i - 1 AS INT) AS result_no, sha256('child' || (s.user_id % 9 + i)) AS sha256
    FROM (
      SELECT r8.seq, max_by(s.seq, (s.ts, s.seq)) AS status_id
      FROM r8 JOIN examined USING (seq) JOIN ev s ON s.event_type = 'purchase' AND s.status = 'completed' AND s.value / 10 > 3
        AND s.author_name = 'plugin3' AND s.author_version = 'v1' AND s.sha256 = r8.sha256 AND s.ts <= r8.ts AND s.ts > r8.ts - INTERVAL 2 DAY
      WHERE reason8 = 'ReplayPluginCompletion-cached' GROUP BY r8.seq) x
    JOIN (SELECT *, unnest(range(1, k % 3 + 1)) AS i FROM ev) s ON s.seq = status_id"""), _long_memory(ACTIVE_SQL), _long_memory(EXAMINED_SQL)))
def _fetch_replayed(spark, sf):
    cached = replay.cacheable(A.statuses(spark, sf), min_runtime_s=0.0)
    ctx = replace(_context(spark, sf, True), statuses=cached, replay_ttl_s=40 * 86_400)
    return FE.fetch(A.messages(spark, sf), replace(FETCH_SPEC, count=1000, deny_self=False), ctx, ["timestamp", "seq"]).replayed().select(
        "seq", "status_id", "result_no", "entity.sha256")


@query("fetch_tombstones", A.sql("""
    SELECT 'grid.main.' || source_name || '.binary.' || action AS topic, kafka_key AS key, NULL AS value
    FROM r8 JOIN examined USING (seq) WHERE reason8 = 'FilterPreviouslyDeleted-deleted'""", ACTIVE_SQL, EXAMINED_SQL))
def _fetch_tombstones(spark, sf):
    topic = F.concat(F.lit("grid.main."), "source.name", F.lit(".binary."), "action")
    return FE.fetch(A.messages(spark, sf).withColumn("topic", topic), FETCH_SPEC, _context(spark, sf, True), ["timestamp", "seq"]).tombstones()


@query("consume_lookup_first", A.sql("""
    SELECT seq, CASE WHEN by_id OR by_link OR by_author OR by_submission THEN 'FilterPreviouslyDeleted-deleted'
      WHEN depth > 10 THEN 'FilterTooDeep-too_deep'
      WHEN source_ts + to_days(CAST(CASE source_name WHEN 'src0' THEN 20 WHEN 'src1' THEN 10 WHEN 'src2' THEN 10 END AS INT))
        < TIMESTAMP '2024-01-31 00:00:00' THEN 'PipelineAgeoff-ageoff' END AS reason FROM judged""", DELETES_SQL.strip()))
def _consume_lookup_first(spark, sf):
    """A deletion lookup before row rules: it speaks first, and the rules judge what it leaves."""
    plan = ConsumePlan([
        deleted_stage(purge.settle_register(A.deletes(spark, sf))), depth_stage(V.DEPTH_ACTIVE), ageoff_stage(A.sources(spark), A.NOW)])
    return plan.run(A.messages(spark, sf)).select("seq", "reason")


@query("consume_passive", A.sql("SELECT seq, reason6 AS reason FROM r6", PASSIVE_SQL))
def _consume_passive(spark, sf):
    return passive_plan(FETCH_SPEC, _context(spark, sf, False)).run(A.messages(spark, sf)).select("seq", "reason")


# Messages of the publish plan: originals, results of completed statuses,
# children of inserts; then keys, deletions and settings.
PUBLISH_SQL = "\n".join([
    DELETES_SQL.strip() + ",", INSERTS_SQL.strip() + ",", AGEOFF_SQL.strip() + ",", PATH_SQL.strip() + ",", KEY_SQL.strip() + ",", """
fresh AS (
  SELECT a.*, kafka_key AS old_key, event_type = 'purchase' AS is_status, by_link OR by_author OR by_submission AS purged
  FROM aged a JOIN (SELECT seq, by_link, by_author, by_submission FROM judged) USING (seq)),
alive AS (SELECT * FROM fresh WHERE NOT coalesce(source_ts + to_days(CAST(days AS INT)) < TIMESTAMP '2024-01-31 00:00:00', false)),
results AS (SELECT *, unnest(range(1, k % 3 + 1)) AS i FROM alive WHERE is_status AND status = 'completed'),
children AS (
  SELECT alive.seq, insert_key, child_sha256, child_author, alive.depth, md5(
      source_name || '.' || security || '.' || strftime(source_ts, '%Y-%m-%dT%H:%M:%S') || '.batch.' || (k % 3) || '.user.' || (user_id % 20) || '.'
      || CASE WHEN user_id % 2 = 0 THEN 'a.b.remove_at_depth.' || (3 + user_id % 4) || '.' ELSE '' END || coalesce(s.glued, '')
      || coalesce(p.name || '.' || p.node_action || '.' || p.node_sha || '.', '')
      || child_author || '.extracted.' || child_sha256 || '.') AS kafka_key,
    user_id % 2 = 0 AND alive.depth + 1 < 3 + user_id % 4 AS has_settings
  FROM alive JOIN inserts ON parent_sha256 = sha256
  LEFT JOIN nodes p ON p.seq = alive.seq AND p.i = alive.depth LEFT JOIN securities s ON s.seq = alive.seq
  WHERE NOT is_status AND action IN ('sourced', 'extracted', 'augmented') AND (alive.depth < 2 OR user_id % 2 = 1))
"""])


def _published(spark, sf) -> DataFrame:
    plan = produce.publish_plan(
        A.NOW, A.sources(spark), inject.settle_register(A.inserts(spark, sf)), purge.settle_register(A.deletes(spark, sf)))
    return plan.run(A.mixed(spark, sf))


@query("publish_plan", A.sql("""
    SELECT seq, CASE WHEN is_status THEN 'status' ELSE 'binary' END AS model, NULL AS added_by,
      CASE WHEN is_status THEN md5(dequeued || '.' || author_name) ELSE keyed.kafka_key END AS kafka_key,
      CASE WHEN NOT is_status THEN user_id % 2 = 0 AND depth < 3 + user_id % 4 END AS has_settings
    FROM alive LEFT JOIN keyed USING (seq) WHERE is_status OR (depth > 0 AND NOT purged)
    UNION ALL SELECT seq, 'binary', 'ProduceStatusResults', keyed.kafka_key, user_id % 2 = 0 AND depth < 3 + user_id % 4
    FROM results JOIN keyed USING (seq) WHERE NOT purged
    UNION ALL SELECT seq, 'binary', 'InjectChildEvents', kafka_key, has_settings FROM children""", PUBLISH_SQL))
def _publish_plan(spark, sf):
    done = produce.survivors(_published(spark, sf))
    settings = F.when(F.col("model") == "binary", F.size("source.settings") > 0)
    return done.select("seq", "model", "added_by", "kafka_key", settings.alias("has_settings"))


@query("produce_user_stages", A.sql("""
    SELECT seq, source_name, action, added_by, dropped_by FROM (
      SELECT seq, source_name, CASE WHEN action = 'mapped' AND depth > 0 THEN 'enriched' ELSE action END AS action, NULL AS added_by,
        CASE WHEN depth = 0 THEN 'Shallow' END AS dropped_by FROM ev
      UNION ALL SELECT seq, 'copy' || i, 'extracted', 'Copies', CASE WHEN i = 2 THEN 'Second' END
      FROM (SELECT seq, unnest(range(0, k % 4)) AS i FROM ev WHERE depth > 0 AND action = 'sourced'))"""))
def _produce_user_stages(spark, sf):
    """Three stages of one's own: one drops and changes, one sends up to three copies, one drops the last copy."""
    messages = A.messages(spark, sf).join(A.scalars(spark, sf).select("seq", "k"), "seq").select("seq", "model", "source", "action", "k")

    def copies(df):
        number = F.when(F.col("action") == "sourced", F.col("k") % 4).otherwise(0)
        return F.transform(F.when(number > 0, F.sequence(F.lit(0), number - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.struct(
            F.lit("binary").alias("model"), F.lit("extracted").alias("action"), F.col("source").withField("name", F.concat(F.lit("copy"), i.cast("string"))).alias("source")))

    plan = produce.ProducePlan([
        produce.user_stage("Shallow", drop=lambda df: F.size("source.path") == 0, replace=lambda df: {
            "action": F.when(F.col("action") == "mapped", "enriched").otherwise(F.col("action"))}),
        produce.user_stage("Copies", additional=copies),
        produce.user_stage("Second", drop=lambda df: F.col("source.name") == "copy2"),
    ])
    return plan.run(messages).select("seq", F.col("source.name").alias("source_name"), "action", "added_by", "dropped_by")


@query("produce_counts", A.sql("""
    SELECT stage, CAST(sum(removed) AS BIGINT) AS removed, CAST(sum(added) AS BIGINT) AS added FROM (
      SELECT 'PipelineAgeoff' AS stage, (SELECT count(*) FROM fresh) - (SELECT count(*) FROM alive) AS removed, 0 AS added
      UNION ALL SELECT 'ProduceStatusResults', 0, count(*) FROM results
      UNION ALL SELECT 'InjectChildEvents', 0, count(*) FROM children
      UNION ALL SELECT 'InjectId', count(*) FILTER (NOT is_status AND depth = 0), 0 FROM alive
      UNION ALL SELECT 'InjectId', count(*) FILTER (depth = 0), 0 FROM results
      UNION ALL SELECT 'FilterPreviouslyDeleted', count(*) FILTER (NOT is_status AND depth > 0 AND purged), 0 FROM alive
      UNION ALL SELECT 'FilterPreviouslyDeleted', count(*) FILTER (depth > 0 AND purged), 0 FROM results)
    GROUP BY stage""", PUBLISH_SQL))
def _produce_counts(spark, sf):
    return produce.produce_counts(_published(spark, sf))


DELIVERIES_SQL = """
    SELECT feed, priority, count(*) AS n FROM (
      SELECT 'expedite' AS feed, 0 AS priority FROM ev JOIN (SELECT CAST(user_id % 4 AS INT) AS p, max(seq) AS c FROM ev WHERE k = 0 AND event_type <> 'purchase' GROUP BY 1) o
        ON p = user_id % 4 WHERE k = 0 AND seq >= c
      UNION ALL
      SELECT 'historic', 2 FROM ev LEFT JOIN (SELECT CAST(user_id % 4 AS INT) AS p, source_name AS s, action AS a, max(seq) AS c FROM ev
          WHERE k NOT IN (0, 2) AND k >= 50 AND event_type <> 'purchase' GROUP BY ALL) o ON p = user_id % 4 AND s = source_name AND a = action
        WHERE k NOT IN (0, 2) AND source_name <> 'src4' AND seq >= coalesce(c, 0))
    GROUP BY ALL"""


def _feed_progress(spark, sf):
    """Group alpha reads the expedite feed, group beta the historic one."""
    offsets = A.offsets(spark, sf)
    return offsets.withColumn("consumer_group", F.when(
        F.col("consumer_group") == "grid-alpha-live", "grid-key-expedite").otherwise("grid-key-historic"))


@query("fetch_from_log", A.sql(DELIVERIES_SQL))
def _fetch_from_log(spark, sf):
    rows = FE.deliveries(A.topic_log(spark, sf), _feed_progress(spark, sf), "key", FETCH_SPEC)
    return rows.groupBy("feed", "priority").agg(F.count("*").alias("n"))


@query("fetch_from_stored_log", A.sql(DELIVERIES_SQL))
def _fetch_from_stored_log(spark, sf):
    path = work_path(spark, "log")
    layout.append_log(A.topic_log(spark, sf), path, band=5000)
    rows = FE.deliveries(layout.stored_log(spark, path), _feed_progress(spark, sf), "key", FETCH_SPEC)
    return rows.groupBy("feed", "priority").agg(F.count("*").alias("n"))


@query("decode_log", A.sql("SELECT seq AS \"offset\", sha256, depth FROM ev"))
def _decode_log(spark, sf):
    decoded = FE.decode_binary(source_log(spark, sf))
    return decoded.select("offset", "entity.sha256", F.size("source.path").alias("depth"))


# --- streams ------------------------------------------------------------------------

def _drain(stream: DataFrame, name: str) -> DataFrame:
    spark = stream.sparkSession
    output = work_path(spark, name)
    keyed.run_caught_up(stream, work_path(spark, f"{name}-checkpoint"), output=output)
    return spark.read.schema(stream.schema).parquet(output)


def _landed(rows: DataFrame, name: str) -> DataFrame:
    """Rows as a stream of the files they are written to: a log as it lies, with its columns built once."""
    folder = work_path(rows.sparkSession, name)
    rows.write.parquet(folder)
    return rows.sparkSession.readStream.schema(rows.schema).parquet(folder)


@query("dedupe_stream", A.sql("""
    SELECT author_name AS consumer, kafka_key, CAST(CASE WHEN bypass OR expedite THEN 1 ELSE 0 END AS INT) AS exempt,
      CASE WHEN bypass OR expedite THEN count(*) ELSE 1 END AS n
    FROM ev WHERE bypass OR expedite OR kafka_key <> '' GROUP BY author_name, kafka_key, bypass OR expedite"""))
def _dedupe_stream(spark, sf):
    source = A.messages_of(A.stream(spark, sf)).withColumn("consumer", F.col("author.name"))
    exempt = (F.col("flags.bypass_cache") | F.col("flags.expedite")).cast("int")
    kept = stateful.dedupe_stream(source, ["consumer"], "1 hour").select("consumer", "kafka_key", exempt.alias("exempt"))
    return _drain(kept, "dedupe").groupBy("consumer", "kafka_key", "exempt").agg(F.count("*").alias("n"))


@query("lost_task_stream", A.sql("""
    SELECT seq FROM ev WHERE k % 3 = 0 AND ts < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 30 MINUTE"""))
def _lost_task_stream(spark, sf):
    """Tasks finish unless their code is divisible by 3; what is overdue by the clock is lost."""
    flat = A.scalars_of(A.stream(spark, sf, files=None))
    task = F.concat(F.col("kafka_key"), F.lit("/"), F.col("seq").cast("string")).alias("dequeued")
    starts = flat.select("seq", task, F.col("ts").alias("started_at"))
    return _drain(keyed.lost_task_stream(starts, flat.where("k % 3 <> 0").select(task), now=A.NOW), "lost").select("seq")


@query("throttled_pause_stream", THROTTLED_SQL)
def _throttled_pause_stream(spark, sf):
    """Errors with codes below 50 pause; all other rows, and one last one, only move time on."""
    flat = A.scalars(spark, sf).select(F.col("ts").alias("paused_at"), F.expr("event_type = 'error' AND k < 50").alias("is_pause"))
    last = flat.agg((F.max("paused_at") + F.expr("INTERVAL 1 HOUR")).alias("paused_at")).where("paused_at IS NOT NULL").withColumn("is_pause", F.lit(False))
    kept = keyed.throttled_pause_stream(_landed(flat.unionByName(last), "pause-events"), gap_s=6 * 3600)
    return _drain(kept, "pauses").select(F.unix_seconds("paused_at").alias("paused_s"))


@query("purge_stream", A.sql("SELECT seq FROM judged WHERE NOT (by_id OR by_link OR by_author OR by_submission)", DELETES_SQL))
def _purge_stream(spark, sf):
    rows = _landed(A.with_control_rows(A.table(spark, sf, "events"), "delete"), "deletable")
    return _drain(keyed.purge_stream(rows, carry=[]), "purged")


@query("inject_stream", A.sql("""
    SELECT seq, NULL AS injected_key, NULL AS sha256, depth FROM ev
    UNION ALL SELECT ev.seq, insert_key, child_sha256, depth + 1 FROM ev JOIN inserts ON parent_sha256 = sha256
    WHERE action IN ('sourced', 'extracted', 'augmented') AND (depth < 2 OR user_id % 2 = 1)""", INSERTS_SQL))
def _inject_stream(spark, sf):
    rows = _landed(A.with_control_rows(A.table(spark, sf, "events"), "insert"), "injectable")
    child = F.when(F.col("injected_key").isNotNull(), F.col("entity.sha256"))
    found = keyed.inject_stream(rows, A.NOW).select("seq", "injected_key", child.alias("sha256"), F.size("source.path").alias("depth"))
    return _drain(found, "injected")


def _replayed(spark, sf, name: str, **how) -> DataFrame:
    consumer = (F.col("author.name"), F.col("author.version"))
    rows = _landed(A.mixed(spark, sf), "replayable")
    return _drain(keyed.replay_stream(rows, consumer, REPLAY_TTL, min_runtime_s=3.0, **how), name)


@query("replay_stream", A.sql("SELECT seq, status_id FROM hits", REPLAY_SQL))
def _replay_stream(spark, sf):
    return _replayed(spark, sf, "replayed")


@query("replay_stream_results", A.sql("""
    SELECT hits.seq, status_id, CAST(i - 1 AS INT) AS result_no, sha256('child' || (s.user_id % 9 + i)) AS sha256
    FROM hits JOIN (SELECT *, unnest(range(1, k % 3 + 1)) AS i FROM ev) s ON s.seq = status_id""", REPLAY_SQL))
def _replay_stream_results(spark, sf):
    return _replayed(spark, sf, "replayed-results", results_as_of=A.NOW).select("seq", "status_id", "result_no", "entity.sha256")


@query("reprocess_stream", A.sql("""
    SELECT 'grid.next.' || source_name || '.binary.' || action AS topic, keyed.kafka_key AS key, ev.seq AS "offset"
    FROM ev JOIN keyed USING (seq)""", PATH_SQL, KEY_SQL))
def _reprocess_stream(spark, sf):
    path = work_path(spark, "old-log")
    source_log(spark, sf).write.parquet(path)
    log = spark.readStream.schema(schemas.TOPIC_LOG).parquet(path)
    moved = reprocess(log, Naming(), Naming(namespace="next"), upgrade_sources=True)
    return _drain(moved, "reprocessed").select("topic", "key", "offset")

