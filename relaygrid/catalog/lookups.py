"""Operators that join: deletions, inserts, replays, matching, tasks, blobs, pauses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relaygrid.catalog import adapter as A
from relaygrid.catalog.registry import query
from relaygrid.catalog.rows import CONSUMERS_SQL
from relaygrid.functions import content as C
from relaygrid.functions.routing import choose_topic
from relaygrid.operators import blob_store, blobs, consumers, inject, layout, pause, purge, replay, rule_index, tasks
from relaygrid.session import settle

# Deletions over the flat rows: the newest one per kind and token counts.
DELETES_SQL = """
dels AS (
  SELECT *, row_number() OVER (PARTITION BY kind, token ORDER BY seq DESC) AS rn FROM (
    SELECT seq, CASE k WHEN 10 THEN 'ids' WHEN 11 THEN 'submission' WHEN 12 THEN 'link' ELSE 'author' END AS kind,
      CASE k WHEN 10 THEN kafka_key WHEN 11 THEN track_ref WHEN 12 THEN track_link ELSE track_author END AS token,
      CASE WHEN k = 11 AND user_id % 2 = 0 THEN source_ts WHEN k = 13 THEN ts END AS bound
    FROM ev WHERE event_type = 'error' AND k BETWEEN 10 AND 13)),
deletes AS (SELECT * FROM dels WHERE rn = 1),
judged AS (
  SELECT ev.*,
    kafka_key IN (SELECT token FROM deletes WHERE kind = 'ids') AS by_id,
    track_link IN (SELECT token FROM deletes WHERE kind = 'link') AS by_link,
    EXISTS (SELECT 1 FROM deletes d WHERE d.kind = 'author' AND d.token IN (ev.track_author, ev.track_author2) AND ev.ts < d.bound) AS by_author,
    EXISTS (SELECT 1 FROM deletes d WHERE d.kind = 'submission' AND d.token = ev.track_ref
      AND (d.bound IS NULL OR d.bound = ev.source_ts)) AS by_submission
  FROM ev)
"""


def _register(spark, sf) -> DataFrame:
    return purge.settle_register(A.deletes(spark, sf))


@query("latest_deletes", A.sql("SELECT kind, token, CAST(epoch(bound) AS BIGINT) AS bound_s, seq FROM deletes", DELETES_SQL))
def _latest_deletes(spark, sf):
    rows = purge.latest_deletes(A.deletes(spark, sf))
    return rows.select("kind", "token", F.round(F.unix_micros("bound") / 1_000_000).cast("bigint").alias("bound_s"), "seq")


@query("purge_by_id", A.sql("SELECT seq FROM judged WHERE NOT by_id", DELETES_SQL))
def _purge_by_id(spark, sf):
    return purge.purge_by_id(A.messages(spark, sf), _register(spark, sf)).select("seq")


@query("placed_purge_by_id", A.sql("SELECT seq FROM judged WHERE NOT by_id", DELETES_SQL))
def _placed_purge_by_id(spark, sf):
    placed = layout.place_by_key(A.messages(spark, sf).select("seq", "model", "kafka_key"), "kafka_key", 16)
    return layout.placed_purge_by_id(placed, _register(spark, sf)).select("seq")


@query("purge_by_link", A.sql("SELECT seq FROM judged WHERE NOT by_link", DELETES_SQL))
def _purge_by_link(spark, sf):
    return purge.purge_by_link(A.messages(spark, sf), _register(spark, sf)).select("seq")


@query("purge_by_author", A.sql("SELECT seq FROM judged WHERE NOT by_author", DELETES_SQL))
def _purge_by_author(spark, sf):
    return purge.purge_by_author(A.messages(spark, sf), _register(spark, sf)).select("seq")


@query("purge_by_submission", A.sql("SELECT seq FROM judged WHERE NOT by_submission", DELETES_SQL))
def _purge_by_submission(spark, sf):
    return purge.purge_by_submission(A.messages(spark, sf), _register(spark, sf)).select("seq")


@query("judge_purged", A.sql("SELECT seq, by_id OR by_link OR by_author OR by_submission AS purged FROM judged", DELETES_SQL))
def _judge_purged(spark, sf):
    return purge.judge_purged(A.messages(spark, sf), _register(spark, sf)).select("seq", "purged")


@query("tombstones", A.sql("""
    SELECT CASE WHEN expedite THEN 'grid.main.system.expedite' WHEN retry THEN 'grid.main.system.error'
        ELSE 'grid.main.' || source_name || '.binary.' || action END AS topic, kafka_key AS key, CAST(NULL AS VARCHAR) AS value
    FROM judged WHERE by_id OR by_link OR by_author OR by_submission""", DELETES_SQL))
def _tombstones(spark, sf):
    return purge.tombstones(choose_topic(purge.judge_purged(A.messages(spark, sf), _register(spark, sf))))


INSERTS_SQL = """
ins AS (
  SELECT *, row_number() OVER (PARTITION BY parent_sha256, insert_key ORDER BY seq DESC) AS rn FROM (
    SELECT seq, sha256 AS parent_sha256, sha256('child' || (user_id % 9)) AS child_sha256,
      md5(sha256 || '.' || sha256('child' || (user_id % 9))) AS insert_key, 'user' || (user_id % 4) AS child_author
    FROM ev WHERE event_type = 'signup' AND k < 8)),
inserts AS (SELECT * FROM ins WHERE rn = 1)
"""


@query("latest_inserts", A.sql("SELECT parent_sha256, insert_key, seq, child_author FROM inserts", INSERTS_SQL))
def _latest_inserts(spark, sf):
    rows = inject.latest_inserts(A.inserts(spark, sf))
    return rows.select(
        "parent_sha256", F.col("kafka_key").alias("insert_key"), "seq", F.col("insert.child_history.author.name").alias("child_author"))


@query("inject_children", A.sql("""
    SELECT seq, NULL AS injected_key, action, sha256, author_name, source_name, depth FROM ev
    UNION ALL
    SELECT ev.seq, insert_key, 'extracted', child_sha256, child_author, source_name, depth + 1
    FROM ev JOIN inserts ON parent_sha256 = sha256
    WHERE action IN ('sourced', 'extracted', 'augmented') AND (depth < 2 OR user_id % 2 = 1)""", INSERTS_SQL))
def _inject_children(spark, sf):
    register = inject.settle_register(A.inserts(spark, sf))
    out = inject.inject_children(A.messages(spark, sf), register, A.NOW)
    return out.select(
        "seq", "injected_key", "action", "entity.sha256", F.col("author.name").alias("author_name"),
        F.col("source.name").alias("source_name"), F.size("source.path").alias("depth"))


# Each non-purchase is asked for by its author; purchases are the statuses.
# TTL 7 days, runtime over 3 s.
REPLAY_SQL = """
hits AS (
  SELECT e.seq, max_by(s.seq, (s.ts, s.seq)) AS status_id
  FROM ev e JOIN ev s ON s.sha256 = e.sha256 AND s.author_name = e.author_name AND s.author_version = e.author_version
    AND s.ts <= e.ts AND s.ts > e.ts - INTERVAL 7 DAY
  WHERE e.event_type <> 'purchase' AND NOT e.bypass AND s.event_type = 'purchase' AND s.status = 'completed' AND s.value / 10 > 3
  GROUP BY e.seq)
"""
REPLAY_TTL = 7 * 86_400


def _replay_inputs(spark, sf):
    """Events, the cache as a stored table, and the settled matches."""
    events = A.messages(spark, sf).where(F.col("action") != "mapped")
    cached = settle(replay.cacheable(A.statuses(spark, sf), min_runtime_s=3.0), "cache")
    consumer = (F.col("author.name"), F.col("author.version"))
    matches = replay.settle_matches(replay.match_completions(events, cached, consumer, REPLAY_TTL))
    return events, cached, matches


@query("match_completions", A.sql("SELECT seq, status_id FROM hits", REPLAY_SQL))
def _match_completions(spark, sf):
    events = A.messages(spark, sf).where(F.col("action") != "mapped")
    cached = replay.cacheable(A.statuses(spark, sf), min_runtime_s=3.0)
    return replay.match_completions(events, cached, (F.col("author.name"), F.col("author.version")), REPLAY_TTL)


@query("replay_completions", A.sql("""
    SELECT e.seq, status_id, CAST(i - 1 AS INT) AS result_no, e.expedite, e.source_name,
      e.depth + CASE WHEN s.depth > 0 THEN 1 ELSE 0 END AS depth,
      sha256('child' || (s.user_id % 9 + i)) AS sha256
    FROM hits JOIN ev e USING (seq) JOIN (SELECT *, unnest(range(1, k % 3 + 1)) AS i FROM ev) s ON s.seq = status_id""", REPLAY_SQL))
def _replay_completions(spark, sf):
    events, cached, matches = _replay_inputs(spark, sf)
    _, replayed = replay.replay_completions(events, cached, matches, A.NOW)
    return replayed.select(
        "seq", "status_id", "result_no", "flags.expedite", F.col("source.name").alias("source_name"),
        F.size("source.path").alias("depth"), "entity.sha256")


@query("replay_reason", A.sql("""
    SELECT seq, CASE WHEN status_id IS NOT NULL THEN 'cached' END AS replay_reason FROM ev LEFT JOIN hits USING (seq) WHERE event_type <> 'purchase'""", REPLAY_SQL))
def _replay_reason(spark, sf):
    events, cached, matches = _replay_inputs(spark, sf)
    return replay.replay_completions(events, cached, matches, A.NOW)[0].select("seq", "replay_reason")


@query("replay_stats", A.sql("""
    SELECT author_name AS plugin, CAST(count(*) AS BIGINT) AS hits, CAST(round(sum(CAST(round(value * 100) AS BIGINT)) / 10) AS BIGINT) AS centi
    FROM hits JOIN ev ON ev.seq = status_id GROUP BY author_name""", REPLAY_SQL))
def _replay_stats(spark, sf):
    _, cached, matches = _replay_inputs(spark, sf)
    stats = replay.replay_stats(matches, cached)
    return stats.select("plugin", "hits", F.round(F.round(F.col("seconds_saved") * 1000) / 10).cast("bigint").alias("centi"))


@query("artifact_copies", A.sql("""
    SELECT DISTINCT s.source_name AS source_from, e.source_name AS source_to, d.label, d.sha256
    FROM hits JOIN ev e USING (seq) JOIN ev s ON s.seq = status_id
    JOIN (SELECT seq, 'content' AS label, sha256 FROM ev WHERE k % 6 <> 0 UNION ALL SELECT seq, 'text', NULL FROM ev WHERE k % 5 = 0) d ON d.seq = s.seq
    WHERE e.source_name <> s.source_name AND s.k % 3 > 0""", REPLAY_SQL))
def _artifact_copies(spark, sf):
    events, cached, matches = _replay_inputs(spark, sf)
    return replay.artifact_copies(matches, events, cached)


REGISTRY_SQL = CONSUMERS_SQL.strip() + """,
registry AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY consumer_key ORDER BY ts DESC, seq DESC) AS rn FROM consumers
    WHERE ts > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 24 HOUR AND ts <= TIMESTAMP '2024-01-31 00:00:00') WHERE rn = 1)
"""


def _registry(spark, sf) -> DataFrame:
    return consumers.latest_registrations(A.consumers(spark, sf), A.NOW)


@query("latest_registrations", A.sql("SELECT consumer_key, seq FROM registry", REGISTRY_SQL))
def _latest_registrations(spark, sf):
    return _registry(spark, sf).select("consumer_key", "seq")


@query("deployments", A.sql("""
    SELECT deployment_key, max_by(author_name || '-' || author_version || '-binary', (ts, seq)) AS consumer_prefix
    FROM (SELECT *, 'dep' || (user_id % 6) AS deployment_key FROM registry WHERE user_id % 3 = 0) GROUP BY deployment_key""", REGISTRY_SQL))
def _deployments(spark, sf):
    return consumers.deployments(_registry(spark, sf))


MATRIX_SQL = REGISTRY_SQL.strip() + """,
pairs AS (
  SELECT e.seq, c.author_name AS consumer_name, c.author_version AS consumer_version, c.consumer_key,
    CASE WHEN e.depth > 11 THEN 'FilterTooDeep-too_deep' ELSE 'FilterConsumerRules-' || CASE
      WHEN c.user_id % 3 = 1 AND e.source_name NOT IN ('src0', 'src1', 'src4') THEN 'reject_source'
      WHEN c.user_id % 5 = 2 AND e.action NOT IN ('sourced', 'extracted') THEN 'reject_event_type'
      WHEN c.user_id % 5 = 3 AND e.action = 'mapped' THEN 'reject_event_type'
      WHEN c.user_id % 2 = 1 AND e.author_name = c.author_name THEN 'reject_self'
      WHEN e.k % 6 <> 0 AND c.user_id % 6 = 1 AND e.size > 900 THEN 'reject_content_too_large'
      WHEN e.k % 6 <> 0 AND c.user_id % 6 = 2 AND e.size < 100 THEN 'reject_content_too_small'
      WHEN e.k % 6 <> 0 AND c.user_id % 4 = 0 AND e.file_format NOT LIKE 'executable/%' THEN 'reject_file_format'
      WHEN e.k % 5 = 0 AND c.user_id % 4 = 0 THEN 'reject_stream'
      WHEN c.user_id % 4 = 2 AND CAST(e.k % 6 <> 0 AS INT) + CAST(e.k % 5 = 0 AS INT) < 2 THEN 'reject_stream'
      WHEN (c.user_id % 6 IN (1, 2)) AND e.k % 6 = 0 THEN 'reject_no_content' END END AS filter_out_trigger
  FROM ev e CROSS JOIN registry c)
"""


@query("consumer_match_matrix", A.sql("""
    SELECT consumer_key, consumer_name, consumer_version, filter_out_trigger, filter_out_trigger IS NOT NULL AS filter_out, count(*) AS n, CAST(sum(seq) AS BIGINT) AS seqs
    FROM pairs GROUP BY ALL""", MATRIX_SQL))
def _consumer_match_matrix(spark, sf):
    matrix = consumers.consumer_match_matrix(A.messages(spark, sf), _registry(spark, sf), carry=["seq"])
    return matrix.groupBy("consumer_key", "consumer_name", "consumer_version", "filter_out_trigger", "filter_out").agg(
        F.count("*").alias("n"), F.sum("seq").alias("seqs"))


@query("consumer_match_rollup", A.sql("""
    SELECT consumer_key, consumer_name, consumer_version, filter_out_trigger, filter_out_trigger IS NOT NULL AS filter_out, count(*) AS n, CAST(sum(seq) AS BIGINT) AS seqs
    FROM pairs GROUP BY ALL""", MATRIX_SQL))
def _consumer_match_rollup(spark, sf):
    """The matrix by consumer and reason, by rule classes and event signatures."""
    return rule_index.consumer_match_rollup(A.messages(spark, sf), _registry(spark, sf), {"seqs": F.col("seq")})


# Every row starts a task; it finishes unless its code is divisible by 3.
# Overdue after 3 days, forgotten after 6.
TASKS_SQL = """
starts AS (
  SELECT *, k % 3 <> 0 AS finished, floor(epoch(TIMESTAMP '2024-01-31 00:00:00')) - floor(epoch(ts)) AS age FROM ev),
open_keys AS (SELECT dequeued FROM starts GROUP BY dequeued HAVING NOT bool_or(finished))
"""
LOST_AFTER = 3 * 86_400


def _tasks(spark, sf):
    flat = A.scalars(spark, sf).select("seq", "k")
    starts = A.messages(spark, sf).join(flat, "seq")
    done = starts.where(F.col("k") % 3 != 0).select("dequeued")
    return starts.drop("k"), done


@query("lost_tasks", A.sql("""
    SELECT s.seq, 'error-network' AS status, 'lost task: ' || s.dequeued AS error, author_name FROM starts s JOIN open_keys USING (dequeued)
    WHERE age > 3 * 86400 AND age < 6 * 86400""", TASKS_SQL))
def _lost_tasks(spark, sf):
    starts, done = _tasks(spark, sf)
    lost = tasks.lost_tasks(starts, done, A.NOW, LOST_AFTER)
    found = tasks.lost_task_statuses(lost.withColumn("retries", F.col("seq").cast("int")), A.NOW)
    return found.select(
        F.col("status.input.retries").cast("bigint").alias("seq"), "status.status", "status.error",
        F.col("author.name").alias("author_name"))


@query("task_stats", A.sql("""
    SELECT author_name, count(*) AS started, count(*) FILTER (fin) AS finished,
      count(*) FILTER (NOT fin AND age > 3 * 86400) AS lost, count(*) FILTER (NOT fin AND age <= 3 * 86400) AS in_flight
    FROM (SELECT s.*, o.dequeued IS NULL AS fin FROM starts s LEFT JOIN open_keys o USING (dequeued)) GROUP BY author_name""", TASKS_SQL))
def _task_stats(spark, sf):
    starts, done = _tasks(spark, sf)
    named = starts.withColumn("author_name", F.col("author.name"))
    return tasks.task_stats(named, done, A.NOW, LOST_AFTER, by=["author_name"])


@query("finished_ids", A.sql("""
    SELECT dequeued FROM ev WHERE event_type = 'purchase' AND status <> 'heartbeat'"""))
def _finished_ids(spark, sf):
    return tasks.finished_ids(A.statuses(spark, sf))


# --- blobs ------------------------------------------------------------------------

BLOBS_SQL = """
ups AS (
  SELECT doc_id AS upload_id, source, 'content' AS label, encode(text) AS data, n_chars % 9 = 0 AS wrong FROM documents
  UNION ALL SELECT -1 - page_id, 'web', 'page', encode(html), false FROM pages),
described AS (SELECT upload_id, source, label, data, wrong, sha256(data) AS sha256, octet_length(data) AS size FROM ups),
catalog AS (
  SELECT DISTINCT source, label, sha256, size,
    TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(size % 900 AS INT)) AS stored_at
  FROM described WHERE NOT wrong AND size > 0
  UNION ALL
  SELECT DISTINCT '', '', sha256, size, TIMESTAMP '2024-01-01 00:00:00' FROM described WHERE NOT wrong AND size > 0 AND size % 4 = 0),
asked AS (SELECT upload_id, 'src' || (upload_id % 7) AS source, 'content' AS label, sha256 FROM described WHERE upload_id >= 0),
resolved AS (
  SELECT a.*, CASE WHEN e.sha256 IS NOT NULL THEN a.source WHEN b.sha256 IS NOT NULL THEN '' END AS found_source,
    coalesce(e.size, b.size) AS size, coalesce(e.stored_at, b.stored_at) AS stored_at
  FROM asked a LEFT JOIN catalog e ON e.source = a.source AND e.label = a.label AND e.sha256 = a.sha256
  LEFT JOIN catalog b ON b.source = '' AND b.label = '' AND b.sha256 = a.sha256)
"""


def _catalog(spark, sf) -> DataFrame:
    """Good uploads by address; a quarter is also stored without prefix."""
    good, _ = blobs.ingest_blobs(A.uploads(spark, sf), minimal=True)
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    hours = (F.col("size") % 900) * 3_600_000_000
    rows = good.select("source", "label", "sha256", "size", F.timestamp_micros(F.unix_micros(start) + hours).alias("stored_at"), "data")
    bare = rows.where(F.col("size") % 4 == 0).dropDuplicates(["sha256"]).select(
        F.lit("").alias("source"), F.lit("").alias("label"), "sha256", "size", start.alias("stored_at"), "data")
    return settle(rows.unionByName(bare), "blobs")


def _requests(spark, sf) -> DataFrame:
    """Each document asked for under a source it may not be stored in."""
    docs = A.table(spark, sf, "documents")
    return docs.select(
        F.col("doc_id").alias("upload_id"), F.concat(F.lit("src"), F.col("doc_id") % 7).alias("source"),
        F.lit("content").alias("label"), F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256"))


@query("ingest_blobs", A.sql("SELECT source, label, sha256, size FROM catalog WHERE label <> ''", BLOBS_SQL))
def _ingest_blobs(spark, sf):
    return blobs.ingest_blobs(A.uploads(spark, sf))[0].select("source", "label", "sha256", "size")


@query("ingest_blobs_rejected", A.sql("SELECT upload_id, 'sha256 mismatch' AS error FROM described WHERE wrong", BLOBS_SQL))
def _ingest_blobs_rejected(spark, sf):
    return blobs.ingest_blobs(A.uploads(spark, sf), minimal=True)[1].select("upload_id", "error")


@query("content_hashes", A.sql("SELECT upload_id, sha256, size, sha1(data) AS sha1, md5(data) AS md5 FROM described", BLOBS_SQL))
def _content_hashes(spark, sf):
    return A.uploads(spark, sf).select("upload_id", *C.content_hashes(F.col("data"))).select(
        "upload_id", "sha256", "size", "sha1", "md5")


@query("blob_lookup", A.sql("SELECT upload_id, found_source IS NOT NULL AS found, found_source, size FROM resolved", BLOBS_SQL))
def _blob_lookup(spark, sf):
    return blobs.blob_lookup(_requests(spark, sf), _catalog(spark, sf), ["size"]).select(
        "upload_id", "found", "found_source", "size")


@query("read_ranges", A.sql("""
    SELECT upload_id, found_source IS NOT NULL AS found, CASE WHEN upload_id % 50 = 0 THEN 'invalid end' END AS error,
      CASE WHEN found_source IS NOT NULL AND upload_id % 50 > 0 THEN hex(data[11:10 + upload_id % 50]) END AS part
    FROM resolved JOIN (SELECT upload_id, data FROM described) USING (upload_id)""", BLOBS_SQL))
def _read_ranges(spark, sf):
    # every 50th request ends before it starts
    header = F.concat(F.lit("bytes=10-"), (9 + F.col("upload_id") % 50).cast("string"))
    served = blobs.read_ranges(_requests(spark, sf).withColumn("range", header), _catalog(spark, sf))
    return served.select("upload_id", "found", "error", F.hex("part").alias("part"))


def _store(spark, sf, chunk_bytes: int = blob_store.CHUNK) -> blob_store.Store:
    return blob_store.ingest(blob_store.empty(spark, chunk_bytes), A.uploads(spark, sf), "2024-01-01 00:00:00")[0]


STORED_SQL = BLOBS_SQL.strip() + """,
stored AS (SELECT DISTINCT source, label, sha256, size FROM described WHERE NOT wrong AND size > 0),
hit AS (SELECT a.upload_id, s.size, a.sha256 FROM asked a JOIN stored s USING (source, label, sha256))
"""


@query("read_ranges_chunked", A.sql("""
    SELECT upload_id, hit.sha256 IS NOT NULL AS found, CASE WHEN hit.sha256 IS NOT NULL THEN hex(CASE upload_id % 4
      WHEN 0 THEN d.data[greatest(octet_length(d.data) - upload_id % 3000, 1) : octet_length(d.data)]
      WHEN 1 THEN d.data[1000 + upload_id % 700 + 1 : octet_length(d.data)] WHEN 2 THEN d.data[1 : octet_length(d.data)]
      ELSE d.data[upload_id % 2000 + 1 : upload_id % 2000 + 1001] END) END AS part
    FROM asked LEFT JOIN hit USING (upload_id) JOIN (SELECT upload_id, data FROM described) d USING (upload_id)""", STORED_SQL))
def _read_ranges_chunked(spark, sf):
    """Ends, rests, whole texts and spans of 1001 bytes, from chunks of 1 KB."""
    n = F.col("upload_id")
    header = (
        F.when(n % 4 == 0, F.concat(F.lit("bytes=-"), (n % 3000 + 1).cast("string"))).when(n % 4 == 1, F.concat(F.lit("bytes="), (1000 + n % 700).cast("string"), F.lit("-")))
        .when(n % 4 == 2, "").otherwise(F.concat(F.lit("bytes="), (n % 2000).cast("string"), F.lit("-"), (n % 2000 + 1000).cast("string")))
    )
    served = blob_store.read_ranges(_requests(spark, sf).withColumn("range", header), _store(spark, sf, 1024), "upload_id")
    return served.select("upload_id", "found", F.hex("part").alias("part"))


@query("blob_store_freed", A.sql("""
    SELECT sha256, max(size) AS size FROM stored GROUP BY sha256
    HAVING bool_and(source = 'web' OR (sha256, source) IN (SELECT sha256, 'src' || (upload_id % 7) FROM asked))
      AND NOT bool_or(source = 'web') AND NOT bool_or(size % 3 = 0)""", STORED_SQL))
def _blob_store_freed(spark, sf):
    """Documents a third of which are copied first, then deleted where they are asked for: what no address names is freed."""
    store, asked = _store(spark, sf), _requests(spark, sf)
    sizes = store.refs.select("sha256", "size").distinct()
    third = store.refs.where("size % 3 = 0 AND source <> 'web'").select(F.col("source").alias("source_from"), F.lit("kept").alias("source_to"), "label", "sha256")
    copied, _ = blob_store.copy(store, third)
    left, _ = blob_store.delete(copied, asked.withColumn("if_older_than", F.lit(0)), A.NOW)
    return blob_store.unreferenced(left).join(sizes, "sha256").select("sha256", "size")


@query("blob_copy", A.sql("""
    SELECT source, label, sha256, size FROM catalog
    UNION SELECT 'src' || ((upload_id + 3) % 7), label, sha256, size FROM resolved WHERE found_source IS NOT NULL""", BLOBS_SQL))
def _blob_copy(spark, sf):
    asked = _requests(spark, sf).withColumn("source_to", F.concat(F.lit("src"), (F.col("upload_id") + 3) % 7))
    copied, _ = blobs.blob_copy(asked.withColumnRenamed("source", "source_from"), _catalog(spark, sf))
    return copied.select("source", "label", "sha256", "size")


@query("blob_delete", A.sql("""
    SELECT upload_id, CASE WHEN found_source IS NULL THEN 'not found'
      WHEN stored_at <= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 15 DAY THEN 'deleted' ELSE 'kept' END AS outcome FROM resolved""", BLOBS_SQL))
def _blob_delete(spark, sf):
    asked = _requests(spark, sf).withColumn("if_older_than", F.lit(15 * 86_400))
    return blobs.blob_delete(asked, _catalog(spark, sf), A.NOW)[1].select("upload_id", "outcome")


@query("blob_delete_remaining", A.sql("""
    SELECT source, label, sha256 FROM catalog EXCEPT
    SELECT found_source, CASE WHEN found_source = '' THEN '' ELSE label END, sha256 FROM resolved
    WHERE stored_at <= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 15 DAY""", BLOBS_SQL))
def _blob_delete_remaining(spark, sf):
    asked = _requests(spark, sf).withColumn("if_older_than", F.lit(15 * 86_400))
    return blobs.blob_delete(asked, _catalog(spark, sf), A.NOW)[0].select("source", "label", "sha256")


# --- pauses -----------------------------------------------------------------------

PAUSES_SQL = """
pauses AS (SELECT ts AS paused_at FROM ev WHERE event_type = 'error' AND k < 50),
gated AS (
  SELECT seq, ts, user_id % 2 = 0 AS is_task, (SELECT max(paused_at) FROM pauses p WHERE p.paused_at <= ev.ts) AS last_pause FROM ev)
"""


@query("pause_gate", A.sql("""
    SELECT seq, CASE WHEN NOT is_task OR last_pause IS NULL THEN 'normal' WHEN ts - last_pause < INTERVAL 10 MINUTE THEN 'paused'
      WHEN ts - last_pause < INTERVAL 30 MINUTE THEN 'latest' ELSE 'normal' END AS gate FROM gated""", PAUSES_SQL))
def _pause_gate(spark, sf):
    asked = A.scalars(spark, sf).select("seq", F.col("ts").alias("requested_at"), (F.col("user_id") % 2 == 0).alias("is_task"))
    return pause.pause_gate(asked, A.pauses(spark, sf)).select("seq", "gate")


#: Pauses more than six hours after the last recorded one.
THROTTLED_SQL = "WITH RECURSIVE " + A.sql("""
    SELECT CAST(floor(epoch(paused_at)) AS BIGINT) AS paused_s FROM recorded WHERE paused_at IS NOT NULL""", PAUSES_SQL, """
    recorded AS (
      SELECT min(paused_at) AS paused_at FROM pauses
      UNION ALL
      SELECT (SELECT min(p.paused_at) FROM pauses p WHERE p.paused_at > r.paused_at + INTERVAL 6 HOUR) FROM recorded r WHERE r.paused_at IS NOT NULL)
    """).removeprefix("WITH ")


@query("throttled_pauses", THROTTLED_SQL)
def _throttled_pauses(spark, sf):
    kept = pause.throttled_pauses(A.pauses(spark, sf), gap_s=6 * 3600)
    return kept.select(F.unix_seconds("paused_at").alias("paused_s"))


@query("reprocess_marks", A.sql("""
    SELECT CAST(epoch_us(ts) + i * 60000000 AS BIGINT) AS paused_us
    FROM (SELECT ts, unnest(range(0, k // 10 + 1)) AS i FROM ev WHERE event_type = 'signup')"""))
def _reprocess_marks(spark, sf):
    """Signups as reprocessing runs that take their code, in tenths of minutes."""
    runs = A.scalars(spark, sf).where(F.col("event_type") == "signup").select(
        F.col("ts").alias("started_at"), F.timestamp_micros(F.unix_micros("ts") + F.col("k") * 6_000_000).alias("ended_at"))
    return pause.reprocess_marks(runs).select(F.unix_micros("paused_at").alias("paused_us"))
