"""Row-wise operators: filters, projections, scalar functions, parsing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relaygrid import schemas
from relaygrid import vocabulary as V
from relaygrid.catalog import adapter as A
from relaygrid.catalog.registry import query
from relaygrid.functions import content as C
from relaygrid.functions import identity, routing
from relaygrid.operators import consumers as K
from relaygrid.operators import filters, inject, oplog, projections, security
from relaygrid.plans import publish as P
from relaygrid.plans import reprocess as R
from relaygrid.plans.decode import decode_messages
from relaygrid.session import config_table, settle, work_path
from relaygrid.sources import batches, logs

SPEC = K.ConsumerSpec(
    name="plugin3", version="v1", is_task=True, require_sources=["src0", "src1", "src2", "src3"],
    deny_events=["mapped"], deny_self=True, require_streams={"content": ["executable/", "text/"], "text": []},
    require_under_content_size=2500, require_over_content_size=30, require_historic=True,
)

# Routing rules of SPEC, stated again over the flat rows: `wanted` lists the
# streams a row carries; the first bad stream in order decides.
RULES_SQL = """
rules AS (
  SELECT *, k % 6 <> 0 AS has_content, k % 5 = 0 AS has_text,
    CASE WHEN source_name NOT IN ('src0', 'src1', 'src2', 'src3') THEN 'reject_source'
         WHEN action = 'mapped' THEN 'reject_event_type'
         WHEN author_name = 'plugin3' THEN 'reject_self'
         WHEN k % 6 <> 0 AND size > 2500 THEN 'reject_content_too_large'
         WHEN k % 6 <> 0 AND size < 30 THEN 'reject_content_too_small'
         WHEN k % 6 <> 0 AND NOT (file_format LIKE 'executable/%' OR file_format LIKE 'text/%') THEN 'reject_file_format'
         WHEN CAST(k % 6 <> 0 AS INT) + CAST(k % 5 = 0 AS INT) < 2 THEN 'reject_stream'
         WHEN k % 6 = 0 THEN 'reject_no_content'
    END AS rule
  FROM ev)
"""

PATH_SQL = """
nodes AS (
  SELECT seq, i,
    'plugin' || ((user_id + i) % 7) AS name,
    CASE WHEN i = depth THEN action ELSE 'extracted' END AS node_action,
    sha256(CAST(CAST(user_id + floor((depth - i) * (1 + user_id % 2) / 2) AS BIGINT) % 21 AS VARCHAR)) AS node_sha,
    ['', 'LOW', 'MEDIUM', 'HIGH MOD1'][(user_id + i) % 4 + 1] AS node_security
  FROM (SELECT *, unnest(range(1, depth + 1)) AS i FROM ev)),
securities AS (
  SELECT seq, string_agg(s || '.', '' ORDER BY s) AS glued
  FROM (SELECT DISTINCT seq, node_security AS s FROM nodes WHERE node_security <> '') GROUP BY seq)
"""

KEY_SQL = """
keyed AS (
  SELECT ev.seq, md5(
      source_name || '.' || security || '.' || strftime(source_ts, '%Y-%m-%dT%H:%M:%S') || '.'
      || 'batch.' || (k % 3) || '.user.' || (user_id % 20) || '.'
      || CASE WHEN user_id % 2 = 0 THEN 'a.b.remove_at_depth.' || (3 + user_id % 4) || '.' ELSE '' END
      || coalesce(s.glued, '')
      || coalesce(p.name || '.' || p.node_action || '.' || p.node_sha || '.', '')
      || c.name || '.' || c.node_action || '.' || c.node_sha || '.') AS kafka_key
  FROM ev JOIN nodes c ON c.seq = ev.seq AND c.i = ev.depth
  LEFT JOIN nodes p ON p.seq = ev.seq AND p.i = ev.depth - 1
  LEFT JOIN securities s ON s.seq = ev.seq)
"""


# --- filters --------------------------------------------------------------------

@query("too_deep", A.sql("SELECT seq, CASE WHEN depth > 10 THEN 'too_deep' END AS reason FROM ev"))
def _too_deep(spark, sf):
    df = A.messages(spark, sf)
    return df.select("seq", filters.too_deep(df, V.DEPTH_ACTIVE).alias("reason"))


AGEOFF_SQL = """
aged AS (
  SELECT *, CASE source_name WHEN 'src0' THEN 20 WHEN 'src1' THEN 10 WHEN 'src2' THEN 10 END AS days FROM ev)
"""


@query("ageoff", A.sql(
    "SELECT seq, CASE WHEN source_ts + to_days(CAST(days AS INT)) < TIMESTAMP '2024-01-31 00:00:00' THEN 'ageoff' END AS reason FROM aged",
    AGEOFF_SQL))
def _ageoff(spark, sf):
    df = filters.with_expiry(A.mixed(spark, sf), A.sources(spark))
    return df.select("seq", filters.ageoff(df, A.NOW).alias("reason"))


@query("consumer_rules", A.sql("SELECT seq, rule AS reason FROM rules", RULES_SQL))
def _consumer_rules(spark, sf):
    df = A.messages(spark, sf)
    return df.select("seq", filters.consumer_rules(df, SPEC.column()).alias("reason"))


@query("consumer_rules_status", A.sql(
    """SELECT seq, CASE WHEN event_type <> 'purchase' THEN rule
         WHEN rule IN ('reject_source', 'reject_event_type', 'reject_self') THEN rule END AS reason FROM rules""",
    RULES_SQL))
def _consumer_rules_status(spark, sf):
    df = A.mixed(spark, sf)
    return df.select("seq", filters.consumer_rules(df, SPEC.column()).alias("reason"))


@query("self_filter", A.sql("SELECT seq, CASE WHEN author_name = 'plugin3' THEN 'ignored' END AS reason FROM ev"))
def _self_filter(spark, sf):
    df = A.messages(spark, sf)
    return df.select("seq", filters.self_filter(df, "plugin3").alias("reason"))


@query("flag_filter", A.sql("SELECT seq, CASE WHEN bypass THEN 'filter_flagged' END AS reason FROM ev"))
def _flag_filter(spark, sf):
    df = A.messages(spark, sf)
    return df.select("seq", filters.flag_filter(df, "bypass_cache").alias("reason"))


@query("security_filter", A.sql(
    "SELECT seq, CASE WHEN security NOT IN ('', 'LOW', 'MEDIUM') THEN 'max_security' END AS reason FROM ev"))
def _security_filter(spark, sf):
    df, limit = A.messages(spark, sf), F.lit("MEDIUM")
    access = settle(security.security_access(security.label_pairs(df, limit), A.SCHEME), "access")
    joined = security.with_access(df, access, limit)
    return joined.select("seq", security.security_filter(joined, limit).alias("reason"))


@query("security_access", A.sql("""
    SELECT DISTINCT m.security AS max_security, e.security,
      m.security <> '' AND e.security <> ''
      AND list_position(['LOW', 'MEDIUM', 'HIGH MOD1'], e.security) <= list_position(['LOW', 'MEDIUM', 'HIGH MOD1'], m.security) AS allowed
    FROM (SELECT DISTINCT security, author_name FROM ev) m JOIN (SELECT DISTINCT security, author_name FROM ev) e USING (author_name)"""))
def _security_access(spark, sf):
    labels = A.messages(spark, sf).select("author.name", F.col("source.security").alias("security")).distinct()
    limits = labels.withColumnRenamed("security", "max_security")
    pairs = limits.join(labels, "name").select("max_security", "security").distinct()
    return security.security_access(pairs, A.SCHEME)


@query("drop_tombstones", A.sql("""
    SELECT topic, count(*) AS n, CAST(sum(seq) AS BIGINT) AS offsets FROM log WHERE body <> '' GROUP BY topic""", """
    log AS (SELECT seq,
      CASE WHEN expedite THEN 'grid.main.system.expedite' WHEN retry THEN 'grid.main.system.error'
        ELSE 'grid.main.' || source_name || '.binary.' || action END AS topic,
      CASE WHEN event_type = 'error' AND k < 20 THEN NULL WHEN k = 98 THEN '' ELSE '{"size":' || size || '}' END AS body
      FROM ev)"""))
def _drop_tombstones(spark, sf):
    kept = filters.drop_tombstones(A.topic_log(spark, sf))
    return kept.groupBy("topic").agg(F.count("*").alias("n"), F.sum("offset").alias("offsets"))


@query("drop_undecodable", A.sql("""
    SELECT seq AS "offset", size FROM ev WHERE NOT (event_type = 'error' AND k < 20) AND k <> 98 AND k % 7 <> 3"""))
def _drop_undecodable(spark, sf):
    log = A.topic_log(spark, sf)
    broken = A.scalars(spark, sf).select(F.col("seq").alias("offset"), ((F.col("k") % 7) == 3).alias("cut"))
    cut = log.join(broken, "offset").withColumn(
        "value", F.when(F.col("cut") & (F.col("value") != ""), F.expr("left(value, length(value) - 1)")).otherwise(F.col("value")))
    decoded = filters.drop_undecodable(filters.drop_tombstones(cut), schemas.struct(size=schemas.LONG))
    return decoded.select("offset", F.col("event.size").alias("size"))


@query("retention", A.sql("""
    SELECT topic, count(*) AS n FROM (
      SELECT CASE WHEN expedite THEN 'grid.main.system.expedite' WHEN retry THEN 'grid.main.system.error'
        ELSE 'grid.main.' || source_name || '.binary.' || action END AS topic, source_name, expedite OR retry AS fixed, ts FROM ev)
    WHERE NOT (fixed AND ts < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY)
      AND NOT (NOT fixed AND source_name IN ('src1', 'src2') AND ts < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 10 DAY)
      AND NOT (NOT fixed AND source_name = 'src0' AND ts < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 20 DAY)
    GROUP BY topic"""))
def _retention(spark, sf):
    fixed = [(f"grid.main.{suffix}", cleanup, ms) for suffix, cleanup, ms in V.SYSTEM_TOPIC_POLICIES]
    system = config_table(spark, fixed, schemas.TOPIC_POLICY)
    per_action = A.sources(spark).where("expire_ms > 0").select(
        F.explode(F.array(*map(F.lit, V.ACTIONS))).alias("action"), "source_name", "expire_ms")
    own = per_action.select(
        F.concat(F.lit("grid.main."), "source_name", F.lit(".binary."), "action").alias("topic"),
        F.lit("delete").alias("cleanup"), F.col("expire_ms").alias("retention_ms"))
    kept = filters.retention(A.topic_log(spark, sf), system.unionByName(own), A.NOW)
    return kept.groupBy("topic").agg(F.count("*").alias("n"))


# --- identity, routing and other projections --------------------------------------

@query("identity_key", A.sql("""
    SELECT ev.seq, CASE WHEN event_type = 'purchase' THEN md5(dequeued || '.' || author_name) ELSE keyed.kafka_key END AS kafka_key
    FROM ev LEFT JOIN keyed USING (seq) WHERE event_type = 'purchase' OR keyed.kafka_key IS NOT NULL""", PATH_SQL, KEY_SQL))
def _identity_key(spark, sf):
    # out of a generator the derived source is a column like a stored one
    df = A.mixed(spark, sf).withColumn("source", F.explode(F.array("source")))
    return identity.identity_key(df).select("seq", "kafka_key")


@query("choose_topic", A.sql("""
    SELECT seq, CASE WHEN event_type = 'purchase' THEN 'grid.main.system.status' WHEN expedite THEN 'grid.main.system.expedite'
      WHEN retry THEN 'grid.main.system.error' ELSE 'grid.main.' || source_name || '.binary.' || action END AS topic FROM ev"""))
def _choose_topic(spark, sf):
    return routing.choose_topic(A.mixed(spark, sf)).select("seq", "topic")


@query("strip_settings_at_depth", A.sql("""
    SELECT seq, user_id % 2 = 0 AND depth < 3 + user_id % 4 AS has_settings FROM ev"""))
def _strip_settings(spark, sf):
    df = projections.strip_settings_at_depth(A.messages(spark, sf))
    return df.select("seq", (F.size("source.settings") > 0).alias("has_settings"))


@query("stamp_dequeued", A.sql("""
    SELECT seq, CASE WHEN kafka_key <> '' THEN kafka_key || '.plugin3.v1.1706659200' ELSE dequeued END AS dequeued,
      CASE WHEN kafka_key = '' THEN 'error_no_id' END AS reason FROM ev"""))
def _stamp_dequeued(spark, sf):
    df, spec = A.messages(spark, sf), SPEC.column()
    stamped = projections.stamp_dequeued(df, spec, A.NOW)
    return stamped.select("seq", "dequeued", projections.dequeue_reason(stamped, spec).alias("reason"))


@query("task_start_record", A.sql("SELECT seq, sha256, size, 0 AS features, 0 AS streams FROM ev"))
def _task_start_record(spark, sf):
    df = projections.task_start_record(A.messages(spark, sf))
    return df.select(
        "seq", "entity.sha256", "entity.size", F.size("entity.features").alias("features"),
        F.size("entity.datastreams").alias("streams"))


@query("strip_status_results", A.sql("""
    SELECT seq, status, CASE WHEN status = 'completed' THEN NULL ELSE CAST(k % 3 AS INT) END AS results FROM ev WHERE event_type = 'purchase'"""))
def _strip_status_results(spark, sf):
    df = projections.strip_status_results(A.statuses(spark, sf))
    return df.select("seq", "status.status", F.when(F.col("status.results").isNotNull(), F.size("status.results")).alias("results"))


@query("inherit_flags", A.sql("""
    SELECT seq, CAST(i AS INT) AS result_no, expedite, bypass AS bypass_cache, false AS retry
    FROM (SELECT *, unnest(range(0, k % 3)) AS i FROM ev WHERE event_type = 'purchase')"""))
def _inherit_flags(spark, sf):
    df = projections.inherit_flags(A.statuses(spark, sf))
    return df.select("seq", F.posexplode("status.results").alias("result_no", "r")).select(
        "seq", "result_no", "r.flags.expedite", "r.flags.bypass_cache", "r.flags.retry")


@query("injectable", A.sql("""
    SELECT seq, action IN ('sourced', 'extracted', 'augmented') AND (depth < 2 OR user_id % 2 = 1) AS injectable FROM ev"""))
def _injectable(spark, sf):
    df = A.messages(spark, sf)
    return df.select("seq", inject.injectable(df).alias("injectable"))


LINKS_SQL = """
edges AS (
  SELECT c.seq, p.node_sha || '.' || c.node_sha || '.' || strftime(ev.ts, '%Y_%m_%dT%H_%M_%SZ_00') || '.plugin.' || c.name || '.v1' AS link
  FROM nodes c JOIN nodes p ON p.seq = c.seq AND p.i = c.i - 1 JOIN ev ON ev.seq = c.seq),
tokens AS (
  SELECT ev.seq, 'src' || (user_id % 5) || '.batch.' || (k % 3) || '.user.' || (user_id % 20) || '.' AS track_source_references,
    coalesce((SELECT string_agg(DISTINCT 'plugin.' || name || '.v1', ',' ORDER BY 'plugin.' || name || '.v1') FROM nodes WHERE nodes.seq = ev.seq), '') AS authors,
    coalesce((SELECT string_agg(DISTINCT link, ',' ORDER BY link) FROM edges WHERE edges.seq = ev.seq), '') AS links FROM ev)
"""


def _token_columns(prefix: str = "") -> list:
    return [
        F.col(f"{prefix}track_source_references").alias("track_source_references"),
        F.array_join(F.array_sort(f"{prefix}track_authors"), ",").alias("authors"), F.array_join(F.array_sort(f"{prefix}track_links"), ",").alias("links"),
    ]


@query("finalise_tracking", A.sql("SELECT * FROM tokens", PATH_SQL, LINKS_SQL))
def _finalise_tracking(spark, sf):
    return P.finalise_tracking(A.messages(spark, sf)).select("seq", *_token_columns())


# --- topics ---------------------------------------------------------------------

@query("scan_topics", A.sql("""
    SELECT seq AS "offset", 'grid.main.' || source_name || '.binary.' || action AS topic FROM ev
    WHERE NOT expedite AND NOT retry AND source_name IN ('src1', 'src3') AND action IN ('sourced', 'augmented')"""))
def _scan_topics(spark, sf):
    log = A.topic_log(spark, sf)
    return oplog.scan_topics(log, ["src1", "src3"], ["sourced", "augmented"]).select("offset", "topic")


@query("scan_topics_open", A.sql("""
    SELECT action, count(*) AS n FROM ev WHERE NOT expedite AND NOT retry AND action IN ('mapped', 'enriched') GROUP BY action"""))
def _scan_topics_open(spark, sf):
    rows = oplog.scan_topics(A.topic_log(spark, sf), None, ["mapped", "enriched"])
    return rows.groupBy(F.element_at(F.split("topic", r"\."), -1).alias("action")).agg(F.count("*").alias("n"))


@query("model_of_topic", A.sql("""
    SELECT topic, CASE WHEN topic LIKE '%system.expedite' THEN 'binary' WHEN topic LIKE '%system.error' THEN 'error' ELSE '' END AS model
    FROM (SELECT DISTINCT CASE WHEN expedite THEN 'grid.main.system.expedite' WHEN retry THEN 'grid.main.system.error'
      ELSE 'grid.main.' || source_name || '.binary.' || action END AS topic FROM ev)"""))
def _model_of_topic(spark, sf):
    topics = A.topic_log(spark, sf).select("topic").distinct()
    return topics.select("topic", routing.model_of_topic(F.col("topic"), True).alias("model"))


# --- parsing --------------------------------------------------------------------

BODIES_SQL = """
bodies AS (
  SELECT seq AS batch_id, k, user_id, sha256, source_name, action, depth,
    CASE WHEN k = 1 THEN '[]' WHEN k BETWEEN 2 AND 4 THEN 'bad' WHEN k BETWEEN 5 AND 9 THEN 'old' ELSE 'fine' END AS kind,
    1 + k % 3 AS items FROM ev)
"""


def bodies(spark, sf) -> DataFrame:
    """One client body per row: a list of 1 to 3 events, some bodies spoilt."""
    flat = A.scalars(spark, sf)
    k = F.col("k")
    version = F.when(k.between(5, 9), "5").otherwise("6")

    def event(i):
        name = F.when((i == 2) & (F.col("user_id") % 2 == 0), "").otherwise(F.col("source_name"))
        return F.concat(
            F.lit('{"model_version":'), version, F.lit(',"action":"'), F.col("action"),
            F.lit('","source":{"name":"'), name, F.lit('","path":[{"sha256":"x"}]},"entity":{"sha256":"'),
            F.col("sha256"), F.lit('","size":'), F.col("size").cast("string"), F.lit("}}"))

    events = F.array_join(F.transform(F.sequence(F.lit(1), 1 + k % 3), event), ",")
    body = (
        F.when(k == 1, "[]").when(k.between(2, 4), F.concat(F.lit("["), events))
        .when(k % 3 == 0, events).otherwise(F.concat(F.lit("["), events, F.lit("]"))))
    return flat.select(F.col("seq").alias("batch_id"), body.alias("body"))


@query("parse_event_batches", A.sql("""
    SELECT batch_id,
      CASE kind WHEN '[]' THEN 'event message too small' WHEN 'bad' THEN 'event message invalid json'
        WHEN 'old' THEN 'event message version was too old or was corrupt' END AS batch_error,
      CAST(CASE WHEN kind = 'fine' THEN items - bad ELSE 0 END AS INT) AS total_ok,
      CAST(CASE WHEN kind = 'fine' THEN bad ELSE 0 END AS INT) AS total_failures
    FROM (SELECT *, CASE WHEN items >= 2 AND user_id % 2 = 0 THEN 1 ELSE 0 END AS bad FROM bodies)""", BODIES_SQL))
def _parse_event_batches(spark, sf):
    return batches.parse_event_batches(bodies(spark, sf), "binary").summary()


@query("parse_event_batches_ok", A.sql("""
    SELECT batch_id, CAST(i - 1 AS INT) AS position, source_name, sha256 FROM
      (SELECT *, unnest(range(1, items + 1)) AS i FROM bodies WHERE kind = 'fine')
    WHERE NOT (i = 2 AND user_id % 2 = 0)""", BODIES_SQL))
def _parse_event_batches_ok(spark, sf):
    ok = batches.parse_event_batches(bodies(spark, sf), "binary").ok()
    return ok.select("batch_id", "position", F.col("source.name").alias("source_name"), "entity.sha256")


@query("reject_outdated_batches", A.sql("""
    SELECT seq, user_id AS batch_id FROM (SELECT *, max(CASE WHEN k = 7 AND event_type = 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id) AS bad FROM ev)
    WHERE bad = 0"""))
def _reject_outdated_batches(spark, sf):
    outdated = (F.col("k") == 7) & (F.col("event_type") == "view")
    rows = A.scalars(spark, sf).select(
        "seq", F.col("user_id").alias("batch_id"), F.when(outdated, 5).otherwise(6).alias("model_version"))
    return batches.reject_outdated_batches(rows).select("seq", "batch_id")


@query("parse_byte_range", A.sql("""
    SELECT seq, CASE k % 6 WHEN 0 THEN 0 WHEN 1 THEN k WHEN 2 THEN -k WHEN 3 THEN k END AS start,
      CASE k % 6 WHEN 0 THEN -1 WHEN 1 THEN -1 WHEN 2 THEN k WHEN 3 THEN size + 1 END AS length,
      CASE k % 6 WHEN 4 THEN 'no range' WHEN 5 THEN 'multiple not supported' END AS error FROM
      (SELECT seq, CAST(k AS BIGINT) AS k, size FROM ev)"""))
def _parse_byte_range(spark, sf):
    k, size = F.col("k"), F.col("size")
    header = (
        F.when(k % 6 == 1, F.concat(F.lit("bytes="), k, F.lit("-"))).when(k % 6 == 2, F.concat(F.lit("bytes=-"), k))
        .when(k % 6 == 3, F.concat(F.lit("bytes="), k, F.lit("-"), k + size)).when(k % 6 == 4, F.concat(F.lit("bytes="), k))
        .when(k % 6 == 5, F.lit("bytes=1-2,4-5")))
    return A.scalars(spark, sf).select("seq", C.parse_byte_range(header).alias("r")).select("seq", "r.*")


@query("epoch_of_id", A.sql("SELECT seq, CAST(floor(epoch(ts)) AS BIGINT) AS started FROM ev"))
def _epoch_of_id(spark, sf):
    return A.messages(spark, sf).select("seq", C.epoch_of_id(F.col("dequeued")).alias("started"))


@query("validate_consumers", A.sql("""
    SELECT seq, CASE
        WHEN k % 9 = 1 THEN 'not a registered model type'
        WHEN k % 9 = 2 THEN 'can only expedite binary events'
        WHEN k % 9 = 3 THEN 'requires at least one of expedite, live or historic'
        WHEN k % 9 = 4 THEN 'bad parameter for count'
        WHEN k % 9 = 5 THEN 'minimum content size above maximum'
        WHEN k % 9 = 6 THEN 'cannot combine actions with content'
        WHEN k % 9 = 7 THEN 'unknown denied action' END AS error,
      CASE WHEN k % 9 <> 4 THEN CAST(CASE WHEN k - 30 <= 0 THEN 1 ELSE least((k - 30) * 40, 1000) END AS INT) END AS count,
      CASE WHEN k % 9 = 8 THEN 'sourced,extracted' WHEN k % 9 = 6 THEN 'sourced,extracted' ELSE '' END AS events,
      'content=executable/;text=' AS streams FROM ev"""))
def _validate_consumers(spark, sf):
    k = F.col("k")
    case = k % 9
    strings = "array<string>"
    raw = A.scalars(spark, sf).select(
        "seq", "author_name", F.col("author_name").alias("name"), F.col("author_version").alias("version"),
        F.when(case == 1, "nothing").when(case == 2, "status").otherwise("binary").alias("model"),
        F.lit("").alias("deployment_key"), F.lit("").alias("max_security"),
        F.when(case == 2, "true").alias("require_expedite"), F.when(case == 3, "false").otherwise("1").alias("require_live"),
        F.lit(None).cast("string").alias("require_historic"),
        F.when(case == 4, "many").otherwise(((k - 30) * 40).cast("string")).alias("count"),
        F.lit(None).cast("string").alias("deadline"), F.lit("t").alias("is_task"),
        F.when(case == 5, "10").alias("require_under_content_size"), F.when(case == 5, "11").alias("require_over_content_size"),
        F.when(case.isin(6, 8), "true").alias("require_content"),
        F.lit(None).cast("string").alias("deny_self"), F.lit(None).cast("string").alias("debug"),
        F.lit(None).cast(strings).alias("require_sources"),
        F.when(case == 6, F.array(F.lit("mapped"))).alias("require_actions"),
        F.when(case == 7, F.array(F.lit("melted"))).alias("deny_actions"),
        F.array(F.lit("content,executable/"), F.lit("text")).alias("require_streams"))
    valid = K.validate_consumers(raw)
    streams = F.array_join(F.transform(
        F.map_entries("require_streams"), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ","))), ";")
    return valid.select("seq", "error", "count", F.array_join("require_events", ",").alias("events"), streams.alias("streams"))


CONSUMERS_SQL = """
consumers AS (
  SELECT *, author_name || '-' || author_version || '-binary-'
      || CASE WHEN user_id % 3 = 1 THEN 'src0.src1.src4' ELSE 'allsrc' END || '-'
      || CASE WHEN user_id % 5 = 2 THEN 'sourced.extracted' ELSE 'alltype' END || '-'
      || CASE WHEN user_id % 7 < 3 THEN 'E' ELSE '' END || 'L' || CASE WHEN user_id % 7 > 4 THEN 'H' ELSE '' END AS consumer_key
  FROM ev WHERE event_type = 'signup')
"""


@query("consumer_key", A.sql("SELECT seq, consumer_key FROM consumers", CONSUMERS_SQL))
def _consumer_key(spark, sf):
    asked = A.consumers(spark, sf)
    return asked.select("seq", identity.consumer_key(K.spec_column(asked)).alias("consumer_key"))


@query("subscriptions", A.sql(r"""
    SELECT seq, feed, CAST(priority AS INT) AS priority, start, 'grid-' || consumer_key || '-' || feed AS consumer_group,
      CASE WHEN feed = 'expedite' THEN '^grid\.main\.system\.expedite$' ELSE
        '^grid\.main\.' || CASE WHEN user_id % 3 = 1 THEN '(src0|src1|src4)' ELSE '[^\.]+' END || '\.binary\.'
        || CASE WHEN user_id % 5 = 2 THEN '(sourced|extracted)' ELSE '[^\.]+' END || '$' END AS pattern
    FROM consumers JOIN (VALUES ('expedite', 0, 'latest'), ('live', 1, 'latest'), ('historic', 2, 'earliest')) f(feed, priority, start)
      ON feed = 'live' OR (feed = 'expedite' AND user_id % 7 < 3) OR (feed = 'historic' AND user_id % 7 > 4)""", CONSUMERS_SQL))
def _subscriptions(spark, sf):
    asked = A.consumers(spark, sf)
    fed = K.subscriptions(asked, carry=["seq"])
    return fed.select("seq", "feed", "priority", "start", "consumer_group", "pattern")


# --- log records ------------------------------------------------------------------

@query("read_access_log", A.sql("""
    SELECT 'GET' AS method, 'r' || (user_id % 6) AS route, CAST(count(*) AS BIGINT) AS n, CAST(sum(200 + 100 * (k % 4)) AS BIGINT) AS statuses
    FROM ev WHERE k % 11 <> 0 GROUP BY route"""))
def _read_access_log(spark, sf):
    folder = work_path(spark, "access-log")
    access_lines(spark, sf).select("line").write.text(folder)
    records = logs.read_access_log(spark, folder).where(F.col("time").isNotNull())
    return records.groupBy("method", "route").agg(F.count("*").alias("n"), F.sum("status").alias("statuses"))


def access_lines(spark, sf) -> DataFrame:
    """Access log lines; codes divisible by 11 give broken ones."""
    k = F.col("k")
    line = F.concat(
        F.lit('{"time":"'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit('","duration_s":"'),
        F.format_string("%.2f", "value"), F.lit('","status":'), (200 + 100 * (k % 4)).cast("string"),
        F.lit(',"method":"GET","route":"r'), (F.col("user_id") % 6).cast("string"), F.lit('"}'))
    return A.scalars(spark, sf).select("seq", F.when(k % 11 == 0, F.lit("{broken")).otherwise(line).alias("line"))


@query("read_pipeline_errors", A.sql("""
    SELECT author_name AS plugin, 'bad' AS description, count(*) AS n, CAST(sum(size) AS BIGINT) AS event_bytes FROM ev WHERE event_type = 'error' GROUP BY author_name"""))
def _read_pipeline_errors(spark, sf):
    errors = A.scalars(spark, sf).where(F.col("event_type") == "error")
    line = F.to_json(F.struct(
        F.col("ts").cast("string").alias("time"), F.col("author_name").alias("plugin"), F.lit("bad").alias("description"),
        F.col("size").alias("event_bytes")))
    folder = work_path(spark, "error-log")
    errors.select(line.alias("line")).write.text(folder)
    records = logs.read_consumer_errors(spark, folder)
    return records.groupBy("plugin", "description").agg(F.count("*").alias("n"), F.sum("event_bytes").alias("event_bytes"))


@query("read_producer_errors", A.sql("""
    SELECT 'pub' || (k % 3) AS pipeline, count(*) AS n, CAST(sum(size) AS BIGINT) AS event_bytes FROM ev WHERE event_type = 'error' GROUP BY 1"""))
def _read_producer_errors(spark, sf):
    errors = A.scalars(spark, sf).where(F.col("event_type") == "error")
    line = F.to_json(F.struct(
        F.col("ts").cast("string").alias("time"), F.concat(F.lit("pub"), F.col("k") % 3).alias("pipeline"), F.col("size").alias("event_bytes")))
    folder = work_path(spark, "producer-log")
    errors.select(line.alias("line")).write.text(folder)
    return logs.read_producer_errors(spark, folder).groupBy("pipeline").agg(F.count("*").alias("n"), F.sum("event_bytes").alias("event_bytes"))


# --- publishing and reprocessing ----------------------------------------------------

@query("publish", A.sql("""
    SELECT CASE WHEN k % 25 = 24 AND NOT expedite AND NOT retry THEN 'missing source or action' WHEN depth > 9 THEN 'message too large' END AS reject_reason,
      count(*) AS n FROM ev GROUP BY 1"""))
def _publish(spark, sf):
    # messages of long lineage get a bulky text, so the size limit separates them
    df = A.messages_beside(spark, sf, ["k", "depth"])
    bulky = F.when(F.col("depth") > 9, F.repeat(F.lit("x"), 20_000)).otherwise("x")
    df = df.withColumn("entity", F.col("entity").withField("info", bulky))
    df = df.withColumn("action", F.when(F.col("k") % 25 == 24, "").otherwise(F.col("action"))).drop("k", "depth")
    return P.publish(df, max_bytes=20_000).report()


@query("publish_rows", A.sql("""
    SELECT seq, CASE WHEN event_type = 'purchase' THEN 'grid.main.system.status' WHEN expedite THEN 'grid.main.system.expedite'
        WHEN retry THEN 'grid.main.system.error' ELSE 'grid.main.' || source_name || '.binary.' || action END AS topic,
      NULL AS reject_reason, CASE WHEN event_type = 'purchase' THEN status END AS status, sha256, depth,
      CASE WHEN event_type <> 'purchase' THEN tokens.track_source_references END AS track_source_references,
      CASE WHEN event_type <> 'purchase' THEN authors END AS authors, CASE WHEN event_type <> 'purchase' THEN links END AS links
    FROM ev JOIN tokens USING (seq)""", PATH_SQL, LINKS_SQL))
def _publish_rows(spark, sf):
    """What a reader of the log gets back of each published message."""
    done = P.publish(A.mixed(spark, sf), max_bytes=1 << 24).judged.select("seq", "topic", "reject_reason", "value", "model")
    back = decode_messages(done.withColumnRenamed("model", "sent"), F.col("sent"))
    about = F.when(F.col("model") == "status", F.col("status.input.entity.sha256")).otherwise(F.col("entity.sha256"))
    path = F.when(F.col("model") == "status", F.col("status.input.source.path")).otherwise(F.col("source.path"))
    binary = F.col("model") == "binary"
    return back.select(
        "seq", "topic", "reject_reason", F.col("status.status").alias("status"), about.alias("sha256"), F.size(path).alias("depth"),
        *[F.when(binary, c).alias(n) for c, n in zip(_token_columns(), ("track_source_references", "authors", "links"), strict=True)])


@query("reprocess_system", A.sql("""
    SELECT seq AS "offset", 'grid.next.system.status' AS topic, md5(dequeued || '.' || author_name) AS key,
      md5(dequeued || '.' || author_name) AS inner_key, status, CAST(k % 3 AS INT) AS results
    FROM (SELECT *, concat_ws('.', kafka_key, author_name, author_version, CAST(floor(epoch(ts)) AS BIGINT)) AS dequeued FROM ev) WHERE event_type = 'purchase'"""))
def _reprocess_system(spark, sf):
    """Statuses re-keyed in the row and inside the value, their payload untouched."""
    df = A.statuses(spark, sf)
    log = df.select(
        F.lit("grid.main.system.status").alias("topic"), F.lit(0).alias("partition"), F.col("seq").alias("offset"),
        F.lit("old").alias("key"), P.encode(df).alias("value"), F.col("timestamp").alias("ts"))
    old, new = routing.Naming(), routing.Naming(namespace="next")
    out = R.reprocess(settle(log, "status-log"), old, new, upgrade_system=True, include_system=["status"])
    read = F.from_json("value", schemas.STATUS)
    return out.withColumn("e", F.explode(F.array(read))).select(
        "offset", "topic", "key", F.col("e.kafka_key").alias("inner_key"), "e.entity.status", F.size("e.entity.results").alias("results"))


@query("reprocess_written_clock", A.sql(
    """SELECT ev.seq AS "offset", keyed.kafka_key AS key FROM ev JOIN keyed USING (seq)""", PATH_SQL,
    KEY_SQL.replace("strftime(source_ts,", "strftime(source_ts + CASE WHEN k % 2 = 1 THEN INTERVAL 11 HOUR ELSE INTERVAL 0 HOUR END,")))
def _reprocess_written_clock(spark, sf):
    """Half of the submission times are written eleven hours east of UTC; the key follows what is written."""
    df = A.messages_beside(spark, sf, ["k"])
    east = F.date_format(F.timestamp_micros(F.unix_micros("source.timestamp") + 11 * 3_600_000_000), "yyyy-MM-dd'T'HH:mm:ss'+11:00'")
    written = df.withColumn("source_clock", F.when(F.col("k") % 2 == 1, east).otherwise(F.date_format("source.timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'")))
    log = written.select(
        F.concat(F.lit("grid.main."), "source.name", F.lit(".binary."), "action").alias("topic"), F.lit(0).alias("partition"),
        F.col("seq").alias("offset"), F.col("kafka_key").alias("key"), P.encode(written).alias("value"), F.col("timestamp").alias("ts"))
    out = R.reprocess(settle(log, "written-log"), routing.Naming(), routing.Naming(namespace="next"), upgrade_sources=True)
    return out.select("offset", "key")


@query("reprocess", A.sql("""
    SELECT source_topic, topic, keyed.kafka_key AS key, ev.seq AS "offset" FROM (
      SELECT *, 'grid.main.' || source_name || '.binary.' || action AS source_topic,
        'grid.next.' || source_name || '.binary.' || action AS topic FROM ev) ev JOIN keyed USING (seq)
    WHERE source_topic <> 'grid.main.src4.binary.mapped'""", PATH_SQL, KEY_SQL))
def _reprocess(spark, sf):
    old, new = routing.Naming(), routing.Naming(namespace="next")
    out = R.reprocess(source_log(spark, sf), old, new, upgrade_sources=True, deny=["grid.main.src4.binary.mapped"])
    return out.select("source_topic", "topic", "key", "offset")


def source_log(spark, sf) -> DataFrame:
    """All messages encoded and stored as a log of source topics."""
    df = A.messages(spark, sf)
    plain = df.withColumn("flags", F.lit(None).cast(schemas.FLAGS))
    return settle(plain.select(
        F.concat(F.lit("grid.main."), "source.name", F.lit(".binary."), "action").alias("topic"),
        F.lit(0).alias("partition"), F.col("seq").alias("offset"), F.col("kafka_key").alias("key"),
        P.encode(plain).alias("value"), F.col("timestamp").alias("ts")), "log")
