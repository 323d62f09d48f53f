"""Aggregates, last-writer-wins views, repeats, order and union."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relaygrid import schemas
from relaygrid import vocabulary as V
from relaygrid.catalog import adapter as A
from relaygrid.catalog.registry import query
from relaygrid.catalog.rows import RULES_SQL, SPEC, access_lines, source_log
from relaygrid.functions.routing import Naming, choose_topic
from relaygrid.operators import dedupe, filters, layout, metrics, oplog
from relaygrid.plans import produce
from relaygrid.plans.reprocess import reprocess
from relaygrid.session import work_path
from relaygrid.sources import logs

TOPIC_SQL = """
log AS (
  SELECT *, CASE WHEN expedite THEN 'grid.main.system.expedite' WHEN retry THEN 'grid.main.system.error'
      ELSE 'grid.main.' || source_name || '.binary.' || action END AS topic, CAST(user_id % 4 AS INT) AS partition,
    CASE WHEN event_type = 'error' AND k < 20 THEN NULL WHEN k = 98 THEN '' ELSE '{"size":' || size || '}' END AS body
  FROM ev)
"""


def judged_by_rules(spark, sf) -> DataFrame:
    """All messages with the reason one consumer's plan gives."""
    df = A.messages(spark, sf)
    deep, rules = filters.too_deep(df, V.DEPTH_ACTIVE), filters.consumer_rules(df, SPEC.column())
    reason = F.coalesce(F.concat(F.lit(f"{V.STAGE_DEPTH}-"), deep), F.concat(F.lit(f"{V.STAGE_RULES}-"), rules))
    return df.withColumn("reason", reason)


JUDGED_SQL = RULES_SQL.strip() + """,
judged AS (SELECT *, CASE WHEN depth > 10 THEN 'FilterTooDeep-too_deep' ELSE 'FilterConsumerRules-' || rule END AS reason FROM rules)
"""


# --- counters ---------------------------------------------------------------------

@query("fetch_info", A.sql("""
    SELECT source_name, CAST(count(*) FILTER (reason IS NULL) AS BIGINT) AS fetched, CAST(count(reason) AS BIGINT) AS filtered,
      (SELECT string_agg(reason || '=' || n, ';' ORDER BY reason) FROM (
        SELECT reason, count(*) AS n FROM judged j WHERE j.source_name = o.source_name AND reason IS NOT NULL GROUP BY reason)) AS filters
    FROM judged o GROUP BY source_name""", JUDGED_SQL))
def _fetch_info(spark, sf):
    judged = judged_by_rules(spark, sf).withColumn("source_name", F.col("source.name"))
    info = metrics.fetch_info(judged, ["source_name"])
    counts = F.transform(F.array_sort(F.map_entries("filters")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return info.select("source_name", "fetched", "filtered", F.array_join(counts, ";").alias("filters"))


@query("stage_counts", A.sql("""
    SELECT split_part(reason, '-', 1) AS stage, split_part(reason, '-', 2) AS cause, count(*) AS removed FROM judged WHERE reason IS NOT NULL GROUP BY ALL""", JUDGED_SQL))
def _stage_counts(spark, sf):
    return metrics.stage_counts(judged_by_rules(spark, sf))


@query("publish_stats", A.sql("""
    SELECT 'by_author_model' AS stat, author_name AS a, CASE WHEN event_type = 'purchase' THEN 'status' ELSE 'binary' END AS b, count(*) AS n FROM log GROUP BY ALL
    UNION ALL SELECT 'by_status', author_name, status, count(*) FROM log WHERE event_type = 'purchase' AND author_category <> 'User' GROUP BY ALL
    UNION ALL SELECT 'by_topic', CASE WHEN event_type = 'purchase' THEN 'grid.main.system.status' ELSE topic END, NULL, count(*) FROM log GROUP BY ALL
    UNION ALL SELECT 'by_author', author_name, NULL, count(*) FROM log GROUP BY ALL""", TOPIC_SQL))
def _publish_stats(spark, sf):
    stats = metrics.publish_stats(choose_topic(A.mixed(spark, sf)))
    shaped = [
        df.select(F.lit(name).alias("stat"), F.col(df.columns[0]).alias("a"),
                  (F.col(df.columns[1]) if len(df.columns) > 2 else F.lit(None).cast("string")).alias("b"), "n")
        for name, df in stats.items()
    ]
    out = shaped[0]
    for df in shaped[1:]:
        out = out.unionByName(df)
    return out


@query("consume_stats", A.sql("""
    SELECT coalesce(r.consumer, j.consumer) AS consumer, 'binary' AS model, coalesce(requests, 0) AS requests, coalesce(fetched, 0) AS fetched, coalesce(filtered, 0) AS filtered
    FROM (SELECT author_name AS consumer, count(*) AS requests FROM ev WHERE event_type = 'signup' GROUP BY 1) r
    FULL JOIN (SELECT author_name AS consumer, count(*) FILTER (reason IS NULL) AS fetched, count(reason) AS filtered FROM judged GROUP BY 1) j ON r.consumer = j.consumer""", JUDGED_SQL))
def _consume_stats(spark, sf):
    asked = A.consumers(spark, sf).select(F.col("name").alias("consumer"), "model")
    judged = judged_by_rules(spark, sf).select(F.col("author.name").alias("consumer"), "model", "reason")
    return metrics.consume_stats(asked, judged)


_BOUNDS = ", ".join(f"({float(b)!r})" for b in (5, 10, 25, 50, 100, 250))


@query("histogram", A.sql(f"""
    SELECT author_name, le, CAST(count(*) FILTER (value <= le) AS BIGINT) AS n, CAST(round(sum(CAST(round(value * 100) AS BIGINT))) AS BIGINT) AS centi, count(*) AS count
    FROM ev CROSS JOIN (VALUES {_BOUNDS}, (CAST('Infinity' AS DOUBLE))) b(le) GROUP BY author_name, le"""))
def _histogram(spark, sf):
    rows = A.scalars(spark, sf)
    hist = metrics.histogram(rows, F.col("value"), (5, 10, 25, 50, 100, 250), ["author_name"])
    flat = hist.select("author_name", "sum", "count", F.inline("buckets"))
    return flat.select("author_name", "le", "n", F.round(F.col("sum") * 100).cast("bigint").alias("centi"), "count")


@query("processing_histogram", A.sql(f"""
    SELECT author_name AS publisher, le, CAST(count(*) FILTER (value / 10 <= le) AS BIGINT) AS n
    FROM ev CROSS JOIN (VALUES {', '.join(f'({float(b)!r})' for b in V.PROCESSING_BUCKETS)}, (CAST('Infinity' AS DOUBLE))) b(le)
    WHERE event_type = 'purchase' AND status = 'completed' GROUP BY author_name, le"""))
def _processing_histogram(spark, sf):
    done = A.statuses(spark, sf).where(F.col("status.status") == "completed")
    hist = metrics.histogram(done, F.col("status.runtime"), V.PROCESSING_BUCKETS, [F.col("author.name").alias("publisher")])
    return metrics.histogram_rows(hist, ["publisher"])


@query("access_log_rollup", A.sql("""
    SELECT 'GET' AS method, 'r' || (user_id % 6) AS route, count(*) AS requests, count(*) FILTER (k % 4 >= 2) AS errors,
      CAST(round(1e6 * count(*) FILTER (k % 4 >= 2) / count(*)) AS BIGINT) AS error_ppm,
      CAST(round(sum(CAST(round(value * 100) AS BIGINT))) AS BIGINT) AS centi, count(*) FILTER (value <= 30) AS within_30s
    FROM ev WHERE k % 11 <> 0 GROUP BY route"""))
def _access_log_rollup(spark, sf):
    records = logs.parse_log_lines(access_lines(spark, sf), schemas.ACCESS_LOG)
    rolled = metrics.access_log_rollup(records)
    at_30 = F.filter("buckets", lambda b: b["le"] == 30.0)[0]["n"]
    return rolled.select(
        "method", "route", "requests", "errors", F.round(F.col("error_share") * 1e6).cast("bigint").alias("error_ppm"),
        F.round(F.col("duration_sum") * 100).cast("bigint").alias("centi"), at_30.alias("within_30s"))


@query("access_log_codes", A.sql("""
    SELECT 'GET' AS method, 'r' || (user_id % 6) AS route, CAST(200 + 100 * (k % 4) AS INT) AS status, count(*) AS n
    FROM ev WHERE k % 11 <> 0 GROUP BY ALL"""))
def _access_log_codes(spark, sf):
    return metrics.access_log_codes(logs.parse_log_lines(access_lines(spark, sf), schemas.ACCESS_LOG))


@query("reprocess_stats", A.sql("""
    SELECT source_topic, CAST(sum(n) FILTER (depth > 0) AS BIGINT) AS processed, CAST(sum(n) AS BIGINT) AS total, bool_and(at_end) AS at_end FROM (
      SELECT source_topic, depth, n, max(seq) OVER (PARTITION BY source_topic) = max(CASE WHEN depth > 0 THEN seq END) OVER (PARTITION BY source_topic) AS at_end
      FROM (SELECT 'grid.main.' || source_name || '.binary.' || action AS source_topic, depth, seq, 1 AS n FROM ev))
    GROUP BY ROLLUP (source_topic)"""))
def _reprocess_stats(spark, sf):
    log = source_log(spark, sf)
    return metrics.reprocess_stats(reprocess(log, Naming(), Naming(namespace="next"), upgrade_sources=True), log)


@query("volume_stats", A.sql("""
    SELECT topic, count(*) AS messages, CAST(sum(coalesce(octet_length(encode(body)), 0) + octet_length(encode(kafka_key))) AS BIGINT) AS bytes FROM log GROUP BY topic""", TOPIC_SQL))
def _volume_stats(spark, sf):
    return metrics.volume_stats(A.topic_log(spark, sf))


@query("blob_volume", """
    SELECT CASE WHEN source = 'src1' THEN 'download' ELSE 'upload' END AS direction, count(*) AS blobs, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes
    FROM documents GROUP BY 1""")
def _blob_volume(spark, sf):
    docs = A.table(spark, sf, "documents")
    moved = docs.select(
        F.when(F.col("source") == "src1", "download").otherwise("upload").alias("direction"), F.octet_length("text").cast("bigint").alias("size"))
    return metrics.blob_volume(moved)


@query("idle_consumers", A.sql("""
    SELECT author_name || author_version AS consumer, CAST(floor(epoch(max(ts))) AS BIGINT) AS last_s FROM ev
    WHERE event_type = 'signup' AND k > 60 GROUP BY ALL HAVING max(ts) < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 24 HOUR"""))
def _idle_consumers(spark, sf):
    asked = A.scalars(spark, sf).where((F.col("event_type") == "signup") & (F.col("k") > 60))
    requests = asked.select(F.concat("author_name", "author_version").alias("consumer"), F.col("ts").alias("requested_at"))
    return metrics.idle_consumers(requests, A.NOW).select("consumer", F.unix_seconds("last_request").alias("last_s"))


@query("unidentified_formats", """
    SELECT 'text/' || lang AS mime, 'text in ' || lang AS magic, count(*) AS n FROM documents WHERE n_chars % 3 = 0 GROUP BY lang""")
def _unidentified_formats(spark, sf):
    docs = A.table(spark, sf, "documents")
    described = docs.select(
        F.concat(F.lit("text/"), "lang").alias("mime"), F.concat(F.lit("text in "), "lang").alias("magic"),
        F.when(F.col("n_chars") % 3 == 0, "unknown").otherwise("text/plain").alias("file_format"))
    return metrics.unidentified_formats(described)


# --- the log ----------------------------------------------------------------------

OFFSETS_SQL = TOPIC_SQL.strip() + """,
offsets AS (
  SELECT CASE WHEN k < 50 THEN 'grid-alpha-live' ELSE 'grid-beta-historic' END AS consumer_group, topic, partition, max(seq) AS committed
  FROM log WHERE event_type <> 'purchase' GROUP BY ALL),
ends AS (SELECT topic, partition, max(seq) + 1 AS high_watermark FROM log GROUP BY ALL)
"""


@query("compacted_view", A.sql("""
    SELECT topic, key, "offset", body AS value FROM (
      SELECT topic, kafka_key AS key, seq AS "offset", body, row_number() OVER (PARTITION BY topic, kafka_key ORDER BY seq DESC) AS rn FROM log)
    WHERE rn = 1 AND body IS NOT NULL""", TOPIC_SQL))
def _compacted_view(spark, sf):
    return oplog.compacted_view(A.topic_log(spark, sf)).select("topic", "key", "offset", "value")


@query("resume_scan_earliest", A.sql("""
    SELECT log.topic, count(*) AS n, CAST(min(seq) AS BIGINT) AS first_offset FROM log LEFT JOIN offsets o ON o.topic = log.topic AND o.partition = log.partition
      AND consumer_group = 'grid-beta-historic' WHERE seq >= coalesce(committed, 0) GROUP BY log.topic""", OFFSETS_SQL))
def _resume_scan_earliest(spark, sf):
    rows = oplog.resume_scan(A.topic_log(spark, sf), A.offsets(spark, sf), "earliest", "grid-beta-historic")
    return rows.groupBy("topic").agg(F.count("*").alias("n"), F.min("offset").alias("first_offset"))


@query("resume_scan_latest", A.sql("""
    SELECT log.topic, log.partition, seq AS "offset" FROM log JOIN offsets o ON o.topic = log.topic AND o.partition = log.partition
      AND consumer_group = 'grid-alpha-live' WHERE seq >= committed""", OFFSETS_SQL))
def _resume_scan_latest(spark, sf):
    rows = oplog.resume_scan(A.topic_log(spark, sf), A.offsets(spark, sf), "latest", "grid-alpha-live")
    return rows.select("topic", "partition", "offset")


RESUMED_SQL = """
    SELECT log.topic, log.partition, seq AS "offset", body AS value FROM log LEFT JOIN offsets o ON o.topic = log.topic AND o.partition = log.partition
      AND consumer_group = 'grid-beta-historic' WHERE seq >= coalesce(committed, 0)"""


@query("resume_stored", A.sql(RESUMED_SQL, OFFSETS_SQL))
def _resume_stored(spark, sf):
    path = work_path(spark, "log")
    layout.append_log(A.topic_log(spark, sf), path, band=5000)
    rows = layout.resume_stored(layout.stored_log(spark, path), A.offsets(spark, sf), "earliest", "grid-beta-historic")
    return rows.select("topic", "partition", "offset", "value")


@query("stored_watermarks", A.sql("SELECT topic, partition, high_watermark FROM ends", OFFSETS_SQL))
def _stored_watermarks(spark, sf):
    path = work_path(spark, "log")
    layout.append_log(A.topic_log(spark, sf), path, band=5000)
    return layout.stored_watermarks(layout.stored_log(spark, path))


@query("placed_compacted", A.sql("""
    SELECT topic, key, "offset", body AS value FROM (
      SELECT topic, kafka_key AS key, seq AS "offset", body, row_number() OVER (PARTITION BY topic, kafka_key ORDER BY seq DESC) AS rn FROM log)
    WHERE rn = 1 AND body IS NOT NULL""", TOPIC_SQL))
def _placed_compacted(spark, sf):
    return layout.placed_compacted(layout.place_by_key(A.topic_log(spark, sf), "key", 16)).select("topic", "key", "offset", "value")


@query("lag_report", A.sql("""
    SELECT consumer_group, topic, partition, committed, high_watermark, high_watermark - committed AS lag, committed >= high_watermark - 1 AS caught_up
    FROM offsets JOIN ends USING (topic, partition)""", OFFSETS_SQL))
def _lag_report(spark, sf):
    return oplog.lag_report(A.topic_log(spark, sf), A.offsets(spark, sf))


@query("groups_caught_up", A.sql("""
    SELECT consumer_group, bool_and(committed >= high_watermark - 1) AS caught_up, CAST(sum(high_watermark - committed) AS BIGINT) AS lag
    FROM offsets JOIN ends USING (topic, partition) GROUP BY consumer_group""", OFFSETS_SQL))
def _groups_caught_up(spark, sf):
    return oplog.groups_caught_up(oplog.lag_report(A.topic_log(spark, sf), A.offsets(spark, sf)))


@query("page", A.sql("""
    SELECT log.topic, log.partition, seq AS "offset" FROM log LEFT JOIN offsets o ON o.topic = log.topic AND o.partition = log.partition
      AND consumer_group = 'grid-beta-historic' WHERE seq >= coalesce(committed, 0) ORDER BY ts LIMIT 40 OFFSET 40""", OFFSETS_SQL))
def _page(spark, sf):
    log, offsets = A.topic_log(spark, sf), A.offsets(spark, sf)
    _, after = oplog.page(log, offsets, "grid-beta-historic", 40)
    return oplog.page(log, after, "grid-beta-historic", 40)[0].select("topic", "partition", "offset")


@query("priority_pull", A.sql("""
    SELECT seq, priority FROM (SELECT seq, ts, CASE WHEN expedite THEN 0 WHEN k % 2 = 1 THEN 1 ELSE 2 END AS priority FROM judged WHERE reason IS NULL)
    ORDER BY priority, ts, seq LIMIT 100""", JUDGED_SQL))
def _priority_pull(spark, sf):
    flat = A.scalars(spark, sf).select("seq", "k", "ts")
    kept = judged_by_rules(spark, sf).where(F.col("reason").isNull()).join(flat, "seq")
    priority = F.when(F.col("flags.expedite"), 0).when(F.col("k") % 2 == 1, 1).otherwise(2)
    return oplog.priority_pull(kept.withColumn("priority", priority), 100, ["priority", "ts", "seq"]).select("seq", "priority")


@query("priority_pull_each", A.sql("""
    SELECT author_name, seq, CAST(rank AS INT) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY author_name ORDER BY ts, seq) AS rank FROM judged WHERE reason IS NULL)
    WHERE rank <= 10 + CAST(substr(author_name, 7) AS INT)""", JUDGED_SQL))
def _priority_pull_each(spark, sf):
    kept = judged_by_rules(spark, sf).where(F.col("reason").isNull()).withColumn("author_name", F.col("author.name"))
    limit = F.lit(10) + F.substring("author_name", 7, 9).cast("int")
    pulled = oplog.priority_pull_each(kept, ["author_name"], limit, ["timestamp", "seq"])
    return pulled.select("author_name", "seq", "rank")


@query("colocate_by_key", A.sql("SELECT count(DISTINCT kafka_key) AS keys, true AS each_in_one_partition FROM ev"))
def _colocate_by_key(spark, sf):
    placed = oplog.colocate_by_key(A.messages(spark, sf).select("kafka_key"), 16).withColumn("p", F.spark_partition_id())
    spread = placed.groupBy("kafka_key").agg(F.min("p").alias("first"), F.max("p").alias("last"))
    return spread.agg(F.count("*").alias("keys"), F.bool_and(F.col("first") == F.col("last")).alias("each_in_one_partition"))


# --- repeats ----------------------------------------------------------------------

@query("first_seen", A.sql("""
    SELECT seq, CASE WHEN bypass OR expedite THEN NULL WHEN kafka_key = '' THEN 'error'
      WHEN row_number() OVER (PARTITION BY author_name, kafka_key, bypass OR expedite ORDER BY seq) > 1 THEN 'skipped' END AS dedupe_reason FROM ev"""))
def _first_seen(spark, sf):
    df = A.messages(spark, sf).withColumn("consumer", F.col("author.name"))
    return dedupe.first_seen(df, ["consumer"]).select("seq", "dedupe_reason")


@query("placed_first_seen", A.sql("""
    SELECT seq, CASE WHEN bypass OR expedite THEN NULL WHEN kafka_key = '' THEN 'error'
      WHEN row_number() OVER (PARTITION BY author_name, kafka_key, bypass OR expedite ORDER BY seq) > 1 THEN 'skipped' END AS dedupe_reason FROM ev"""))
def _placed_first_seen(spark, sf):
    df = A.messages(spark, sf).withColumn("consumer", F.col("author.name")).select("seq", "model", "consumer", "kafka_key", "flags")
    return layout.placed_first_seen(layout.place_by_key(df, "kafka_key", 16), ["consumer"]).select("seq", "dedupe_reason")


BOUNDED_SQL = """
hashed AS (SELECT seq, CAST('0x' || substr(md5(kafka_key), 1, 15) AS BIGINT) AS h FROM ev),
held AS (SELECT seq, h, coalesce(lag(h) OVER (PARTITION BY h & 127 ORDER BY seq), 0) AS before FROM hashed)
"""


def _hash15():
    return F.conv(F.substring(F.md5("kafka_key"), 1, 15), 16, 10).cast("bigint")


@query("bounded_first_seen", A.sql("SELECT seq, before = h AS is_repeat, before <> h AND before <> 0 AS is_collision FROM held", BOUNDED_SQL))
def _bounded_first_seen(spark, sf):
    flagged = dedupe.bounded_first_seen(A.messages(spark, sf), 1000, _hash15(), rows_per_split=3000)
    return flagged.select("seq", "is_repeat", "is_collision")


@query("dedupe_stats", A.sql("""
    SELECT count(*) AS lookups, count(*) FILTER (before = h) AS hits, count(*) FILTER (before <> h AND before <> 0) AS collisions FROM held""", BOUNDED_SQL))
def _dedupe_stats(spark, sf):
    return dedupe.dedupe_stats(dedupe.bounded_first_seen(A.messages(spark, sf), 1000, _hash15()))


@query("live_plus_historic", A.sql("""
    SELECT feed, CASE WHEN bypass OR expedite THEN NULL WHEN kafka_key = '' THEN 'error' WHEN rn > 1 THEN 'skipped' END AS reason, count(*) AS n FROM (
      SELECT *, row_number() OVER (PARTITION BY kafka_key, bypass OR expedite ORDER BY delivery) AS rn FROM (
        SELECT *, 'live' AS feed, seq * 2 AS delivery FROM ev WHERE k > 40 UNION ALL SELECT *, 'historic', seq * 2 + 1 FROM ev))
    GROUP BY ALL"""))
def _live_plus_historic(spark, sf):
    codes = A.scalars(spark, sf).select("seq", "k")
    df = A.messages(spark, sf).join(codes, "seq")
    both = oplog.live_plus_historic(df.where(F.col("k") > 40), df)
    flagged = dedupe.first_seen(both, [], row_id="delivery")
    return flagged.groupBy("feed", F.col("dedupe_reason").alias("reason")).agg(F.count("*").alias("n"))


# --- fan-out ----------------------------------------------------------------------

@query("explode_results", A.sql("""
    SELECT seq, 'status' AS model, NULL AS sha256, NULL AS expedite FROM ev WHERE event_type = 'purchase'
    UNION ALL SELECT seq, 'binary', sha256('child' || (user_id % 9 + i)), expedite FROM (
      SELECT *, unnest(range(1, k % 3 + 1)) AS i FROM ev WHERE event_type = 'purchase' AND status = 'completed')
    UNION ALL SELECT seq, 'binary', sha256, expedite FROM ev WHERE event_type <> 'purchase'"""))
def _explode_results(spark, sf):
    out = produce.explode_results(A.mixed(spark, sf))
    return out.select("seq", "model", "entity.sha256", "flags.expedite")


@query("fan_out", A.sql("""
    SELECT action, CAST(count(*) + sum(depth) AS BIGINT) AS n FROM ev GROUP BY action"""))
def _fan_out(spark, sf):
    flat = A.scalars(spark, sf).select("seq", "action", "depth")
    copies = F.when(F.col("depth") > 0, F.transform(F.sequence(F.lit(1), "depth"), lambda _: F.struct("seq", "action", "depth")))
    return produce.fan_out(flat, copies).groupBy("action").agg(F.count("*").alias("n"))
