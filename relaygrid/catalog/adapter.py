"""The given tables seen as messages, logs, tasks, deletions and blobs.

Every frame is derived row by row from ``events``, ``documents`` or ``pages``;
``SQL`` holds the same derivations as DuckDB views, written independently of
the operators, so results can be compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relaygrid import schemas
from relaygrid.operators.security import LabelScheme
from relaygrid.session import config_table, settle, tune

NOW = "2024-01-31 00:00:00"
SCHEME = LabelScheme(
    levels={"LOW": 10, "MEDIUM": 30, "HIGH": 40}, caveats=("MOD1", "MOD2"), groups=("REL:APPLE", "REL:BEE")
)


def stream(spark: SparkSession, sf_dir: str, files: int | None = 1) -> DataFrame:
    """The ``events`` table as a stream, ``files`` of it a batch; all that there are if None."""
    reader = tune(spark).readStream.schema(schemas.EVENTS_TABLE)
    if files is not None:
        reader = reader.option("maxFilesPerTrigger", files)
    # a pattern, because the table may be one file or a folder of files
    return reader.parquet(f"{sf_dir}/events.parque[t]")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read as it lies."""
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shaped(kind: T.StructType, **values: str) -> str:
    """SQL text of a struct of type ``kind``; fields not given are NULL.

    Flat fields are cast one by one and nested ones kept as built: a cast of a
    whole struct would hide its fields from column pruning.
    """

    def part(field: T.StructField) -> str:
        value = values.get(field.name, "NULL")
        nested = isinstance(field.dataType, (T.StructType, T.ArrayType, T.MapType))
        return value if nested and value != "NULL" else f"CAST({value} AS {field.dataType.simpleString()})"

    return "named_struct(" + ", ".join(f"'{f.name}', {part(f)}" for f in kind.fields) + ")"


# fixed values: labels and formats the rows cycle through
_SECURITY = "array('', 'LOW', 'MEDIUM', 'HIGH MOD1')"
_FORMATS = "array('text/plain', 'executable/windows/pe32', 'executable/windows/dll32', 'document/email')"


def scalars_of(rows: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """The flat columns all messages are built from, and those of ``rows`` named in ``carry``."""
    coded = rows.selectExpr("*", "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k")
    flat = coded.selectExpr(
        "event_id AS seq", "CAST(ts AS TIMESTAMP) AS ts", "user_id", "event_type", "value", "k",
        "CASE event_type WHEN 'signup' THEN 'sourced' WHEN 'click' THEN 'extracted' WHEN 'view' THEN 'enriched' "
        "WHEN 'purchase' THEN 'mapped' ELSE 'augmented' END AS action",
        "concat('src', user_id % 5) AS source_name", "concat('plugin', user_id % 7) AS author_name",
        "concat('v', event_id % 3) AS author_version", f"{_SECURITY}[CAST(event_id % 4 AS INT)] AS security",
        "sha2(CAST(user_id % 21 AS STRING), 256) AS sha256", "CAST(floor(value * 10) AS BIGINT) AS size",
        f"{_FORMATS}[k % 4] AS file_format", "k % 14 AS depth", "k = 0 AS expedite", "k % 10 = 1 AS bypass", "k = 2 AS retry",
        *carry,
    )
    key = "CASE WHEN k = 99 THEN '' ELSE md5(concat_ws('|', source_name, sha256, action, file_format)) END"
    return flat.withColumn("kafka_key", F.expr(key))


def scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scalars_of(table(spark, sf_dir, "events"))


def _path() -> str:
    """Lineage: odd users see a new entity at every step, even ones at every other."""
    author = shaped(
        schemas.AUTHOR, name="concat('plugin', (user_id + i) % 7)", version="'v1'", category="'plugin'",
        security=f"{_SECURITY}[CAST((user_id + i) % 4 AS INT)]",
    )
    node = shaped(
        schemas.NODE, author=author, action="CASE WHEN i = depth THEN action ELSE 'extracted' END",
        sha256="sha2(CAST((user_id + floor((depth - i) * (1 + user_id % 2) / 2)) % 21 AS STRING), 256)",
        timestamp="ts", file_format="file_format", size="size",
    )
    empty = f"CAST(array() AS {schemas.SOURCE['path'].dataType.simpleString()})"
    return f"CASE WHEN depth > 0 THEN transform(sequence(1, depth), i -> {node}) ELSE {empty} END"


def _entity(sha256: str) -> str:
    content = shaped(schemas.STREAM, label="'content'", size="size", sha256="sha256", file_format="file_format")
    extra = shaped(schemas.STREAM, label="'text'", size="floor(size / 2)", file_format="'text/plain'")
    streams = f"array_compact(array(CASE WHEN k % 6 <> 0 THEN {content} END, CASE WHEN k % 5 = 0 THEN {extra} END))"
    feature = shaped(schemas.FEATURE, name="'kind'", value="k", type="'integer'")
    return shaped(
        schemas.ENTITY, sha256=sha256, size="size", file_format="file_format",
        features=f"array({feature})", datastreams=streams,
    )


def binary_columns() -> dict[str, str]:
    """SQL text of each field of a binary message, over the flat columns."""
    author = shaped(
        schemas.AUTHOR, name="author_name", version="author_version",
        category="CASE WHEN user_id % 3 = 0 THEN 'User' ELSE 'plugin' END", security="security",
    )
    settings = (
        "CASE WHEN user_id % 2 = 0 THEN map('remove_at_depth', CAST(3 + user_id % 4 AS STRING), 'a', 'b') "
        "ELSE CAST(map() AS map<string,string>) END"
    )
    source = shaped(
        schemas.SOURCE, name="source_name", security="security", timestamp="date_trunc('day', ts)",
        references="map('user', CAST(user_id % 20 AS STRING), 'batch', CAST(k % 3 AS STRING))",
        settings=settings, path=_path(),
    )
    return {
        "model_version": "6", "kafka_key": "kafka_key", "timestamp": "ts", "author": author, "source": source,
        "action": "action", "entity": _entity("sha256"),
        "flags": shaped(schemas.FLAGS, bypass_cache="bypass", expedite="expedite", retry="retry"),
        "dequeued": "concat_ws('.', kafka_key, author_name, author_version, unix_seconds(ts))", "retries": "0",
        "track_source_references": "concat('ref.', source_name, '.', user_id % 20)",
        "track_links": "array(concat('lnk.', user_id % 13, '.', k % 17))",
        "track_authors": (
            "array(concat('plugin.', author_name, '.', author_version), concat('plugin.step', k % 11, '.v1'))"
        ),
    }


def _columns(values: dict[str, str]) -> list[Column]:
    return [F.expr(values[f.name]).alias(f.name) for f in schemas.BINARY.fields]


def _struct(values: dict[str, str]) -> str:
    return "named_struct(" + ", ".join(f"'{f.name}', {values[f.name]}" for f in schemas.BINARY.fields) + ")"


def messages_of(rows: DataFrame) -> DataFrame:
    """All rows as binary messages."""
    return scalars_of(rows).select("seq", F.lit("binary").alias("model"), *_columns(binary_columns()))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages_of(table(spark, sf_dir, "events"))


def messages_beside(spark: SparkSession, sf_dir: str, flat: list[str]) -> DataFrame:
    """:func:`messages` joined by ``seq`` with these flat columns; rows meet before they are widened, so no message moves."""
    events = table(spark, sf_dir, "events")
    beside = scalars_of(events).select(F.col("seq").alias("event_id"), *[F.col(c).alias(f"_{c}") for c in flat])
    met = scalars_of(events.join(beside, "event_id"), tuple(f"_{c}" for c in flat))
    return met.select("seq", F.lit("binary").alias("model"), *_columns(binary_columns()), *[F.col(f"_{c}").alias(c) for c in flat])


def _status_struct() -> str:
    """Outcome of the task a row stands for, with 0 to 2 results."""
    values = binary_columns()
    child = "sha2(concat('child', user_id % 9 + r), 256)"
    changed = {"action": "'extracted'", "dequeued": "CAST(NULL AS STRING)", "entity": _entity(child)}
    results = f"transform(sequence(1, k % 3), r -> {_struct({**values, **changed})})"
    empty = f"CAST(array() AS {schemas.STATUS_ENTITY['results'].dataType.simpleString()})"
    label = "CASE WHEN k % 4 <> 0 THEN 'completed' WHEN k % 8 = 0 THEN 'failed' ELSE 'heartbeat' END"
    return shaped(
        schemas.STATUS_ENTITY, input=_struct(values), status=label, runtime="value / 10",
        error="CASE WHEN k % 8 = 0 THEN 'broke' END", results=f"CASE WHEN k % 3 > 0 THEN {results} ELSE {empty} END",
    )


def statuses_of(rows: DataFrame) -> DataFrame:
    """Purchases as the statuses their tasks ended with."""
    values = binary_columns()
    return scalars_of(rows.where(F.col("event_type") == "purchase")).select(
        "seq", F.lit("status").alias("model"), F.lit(6).alias("model_version"),
        F.lit(None).cast("string").alias("kafka_key"), F.col("ts").alias("timestamp"),
        F.expr(values["author"]).alias("author"), F.expr(_status_struct()).alias("status"),
    )


def statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statuses_of(table(spark, sf_dir, "events"))


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_of(table(spark, sf_dir, "events"))


def mixed_of(rows: DataFrame) -> DataFrame:
    """One log of binaries and statuses (purchases are statuses).

    The payload is built before the columns it shares names with are changed:
    in one select, a lambda would read the changed ones.
    """
    is_status = F.col("event_type") == "purchase"
    flat = scalars_of(rows).withColumn("status", F.when(is_status, F.expr(_status_struct())))
    values = binary_columns()
    header = ("model_version", "timestamp", "author")
    columns = [
        (F.expr(values[f.name]) if f.name in header else F.when(~is_status, F.expr(values[f.name]))).alias(f.name)
        for f in schemas.BINARY.fields
    ]
    return flat.select("seq", F.when(is_status, "status").otherwise("binary").alias("model"), *columns, "status")


# errors with certain codes delete what their row names
IS_DELETE = "event_type = 'error' AND k BETWEEN 10 AND 13"
_DELETE_ACTION = "CASE k WHEN 10 THEN 'ids' WHEN 11 THEN 'submission' WHEN 12 THEN 'link' ELSE 'author' END"
# signups with low codes are manual inserts below their entity
IS_INSERT = "event_type = 'signup' AND k < 8"
_CHILD_SHA = "sha2(concat('child', user_id % 9), 256)"
_INSERT_KEY = f"md5(concat_ws('.', sha256, {_CHILD_SHA}))"


def _delete_entity() -> str:
    values, parts = binary_columns(), schemas.DELETE_ENTITY

    def only(code: int, field: str, **given: str) -> str:
        return f"CASE WHEN k = {code} THEN {shaped(parts[field].dataType, **given)} END"

    return shaped(
        parts, reason="'cleanup'", ids=only(10, "ids", ids="array(kafka_key)"),
        submission=only(
            11, "submission", track_source_references=values["track_source_references"],
            timestamp="CASE WHEN user_id % 2 = 0 THEN date_trunc('day', ts) END",
        ),
        link=only(12, "link", track_link=f"{values['track_links']}[0]"),
        author=only(13, "author", track_author=f"{values['track_authors']}[0]", timestamp="ts"),
    )


def _insert_entity() -> str:
    author = shaped(schemas.AUTHOR, name="concat('user', user_id % 4)", version="'1'", category="'user'")
    return shaped(
        schemas.INSERT_ENTITY, original_source="source_name", parent_sha256="sha256",
        child=shaped(schemas.ENTITY, sha256=_CHILD_SHA, size="size", file_format="file_format"),
        child_history=shaped(schemas.NODE, author=author, action="'extracted'", sha256=_CHILD_SHA, timestamp="ts"),
    )


def deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scalars(spark, sf_dir).where(IS_DELETE).selectExpr(
        "seq", "'delete' AS model", "ts AS timestamp", f"{_DELETE_ACTION} AS action", f"{_delete_entity()} AS entity"
    )


def inserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scalars(spark, sf_dir).where(IS_INSERT).selectExpr(
        "seq", "'insert' AS model", f"{_INSERT_KEY} AS kafka_key", "ts AS timestamp", f"{_insert_entity()} AS insert"
    )


def with_control_rows(rows: DataFrame, model: str) -> DataFrame:
    """Binaries mixed with the ``delete`` or ``insert`` messages some rows send."""
    control = IS_DELETE if model == "delete" else IS_INSERT
    kinds = f"explode(array_compact(array(CASE WHEN {control} THEN '{model}' END, 'binary')))"
    flat = scalars_of(rows).withColumn("model", F.expr(kinds))
    values = binary_columns()
    is_control = f"model = '{model}'"
    if model == "delete":
        payload = f"CASE WHEN {is_control} THEN {_delete_entity()} END AS deletion"
        changed = {"action": f"CASE WHEN {is_control} THEN {_DELETE_ACTION} ELSE action END"}
    else:
        payload = f"CASE WHEN {is_control} THEN {_insert_entity()} END AS insert"
        changed = {"kafka_key": f"CASE WHEN {is_control} THEN {_INSERT_KEY} ELSE kafka_key END"}
    return flat.select("seq", "model", *_columns({**values, **changed}), F.expr(payload))


def sources(spark: SparkSession) -> DataFrame:
    """Expiry per source; src3 never expires, src4 is not configured."""
    day = 86_400_000
    return config_table(spark, [("src0", 20 * day), ("src1", 10 * day), ("src2", 10 * day), ("src3", 0)], schemas.SOURCES)


def topic_log_of(rows: DataFrame) -> DataFrame:
    """The rows as log records; errors with low codes are tombstones."""
    flat = scalars_of(rows)
    topic = (
        F.when(F.col("expedite"), "grid.main.system.expedite").when(F.col("retry"), "grid.main.system.error")
        .otherwise(F.concat(F.lit("grid.main."), "source_name", F.lit(".binary."), "action"))
    )
    value = (
        F.when((F.col("event_type") == "error") & (F.col("k") < 20), F.lit(None).cast("string"))
        .when(F.col("k") == 98, "").otherwise(F.concat(F.lit('{"size":'), F.col("size").cast("string"), F.lit("}")))
    )
    return flat.select(
        topic.alias("topic"), (F.col("user_id") % 4).cast("int").alias("partition"), F.col("seq").alias("offset"),
        F.col("kafka_key").alias("key"), value.alias("value"), "ts",
    )


def topic_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topic_log_of(table(spark, sf_dir, "events"))


def offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress of two groups: the last signup each partition handed them."""
    flat = scalars(spark, sf_dir)
    log = topic_log(spark, sf_dir)
    marks = log.join(flat.where(F.col("event_type") != "purchase").select(F.col("seq").alias("offset"), "k"), "offset")
    group = F.when(F.col("k") < 50, "grid-alpha-live").otherwise("grid-beta-historic")
    reached = marks.groupBy(group.alias("consumer_group"), "topic", "partition").agg(F.max("offset").alias("committed"))
    return settle(reached, "offsets")


def consumers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signups as fetch requests, each with the spec its row implies."""
    flat = scalars(spark, sf_dir).where(F.col("event_type") == "signup")
    user, k = F.col("user_id"), F.col("k")
    none = F.array().cast("array<string>")
    streams = (
        F.when(user % 4 == 0, F.create_map(F.lit("content"), F.array(F.lit("executable/"))))
        .when(user % 4 == 1, F.create_map(F.lit("*"), none))
        .when(user % 4 == 2, F.create_map(F.lit("content"), none, F.lit("text"), F.array(F.lit("text/"))))
        .otherwise(F.create_map().cast("map<string,array<string>>"))
    )
    values = {
        "name": F.col("author_name"), "version": F.col("author_version"), "model": F.lit("binary"),
        "deployment_key": F.when(user % 3 == 0, F.concat(F.lit("dep"), user % 6)).otherwise(""),
        "count": (k - 5), "deadline": F.lit(5), "is_task": user % 2 == 0, "debug": F.lit(False),
        "require_sources": F.when(user % 3 == 1, F.array(F.lit("src0"), F.lit("src1"), F.lit("src4"))).otherwise(none),
        "require_events": F.when(user % 5 == 2, F.array(F.lit("sourced"), F.lit("extracted"))).otherwise(none),
        "deny_events": F.when(user % 5 == 3, F.array(F.lit("mapped"))).otherwise(none),
        "require_content": F.lit(False), "require_streams": streams,
        "require_under_content_size": F.when(user % 6 == 1, 900).otherwise(0),
        "require_over_content_size": F.when(user % 6 == 2, 100).otherwise(0),
        "require_expedite": user % 7 < 3, "require_live": F.lit(True), "require_historic": user % 7 > 4,
        "deny_self": user % 2 == 1, "max_security": F.when(user % 4 == 3, "MEDIUM").otherwise(""),
    }
    spec = [values[f.name].cast(f.dataType).alias(f.name) for f in schemas.CONSUMER.fields]
    return flat.select("seq", F.col("ts").alias("requested_at"), *spec)


def pauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors with codes below 50 as pause requests."""
    flat = scalars(spark, sf_dir)
    return flat.where((F.col("event_type") == "error") & (F.col("k") < 50)).select(F.col("ts").alias("paused_at"))


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and pages as uploads; some announce a wrong hash."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("upload_id"), "source", F.lit("content").alias("label"), F.encode("text", "UTF-8").alias("data"),
        F.when(F.col("n_chars") % 9 == 0, "0" * 64).alias("expected_sha256"),
    )
    pages = table(spark, sf_dir, "pages").select(
        (F.lit(-1) - F.col("page_id")).alias("upload_id"), F.lit("web").alias("source"), F.lit("page").alias("label"),
        F.encode("html", "UTF-8").alias("data"), F.lit(None).cast("string").alias("expected_sha256"),
    )
    return docs.unionByName(pages)


SQL = """
ev AS (
  SELECT event_id AS seq, ts, user_id, event_type, value,
    CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k,
    CASE event_type WHEN 'signup' THEN 'sourced' WHEN 'click' THEN 'extracted' WHEN 'view' THEN 'enriched'
      WHEN 'purchase' THEN 'mapped' ELSE 'augmented' END AS action,
    'src' || (user_id % 5) AS source_name, 'plugin' || (user_id % 7) AS author_name,
    'v' || (event_id % 3) AS author_version,
    ['', 'LOW', 'MEDIUM', 'HIGH MOD1'][event_id % 4 + 1] AS security,
    sha256(CAST(user_id % 21 AS VARCHAR)) AS sha256,
    CAST(floor(value * 10) AS BIGINT) AS size,
    ['text/plain', 'executable/windows/pe32', 'executable/windows/dll32', 'document/email'][k % 4 + 1] AS file_format,
    k % 14 AS depth, k = 0 AS expedite, k % 10 = 1 AS bypass, k = 2 AS retry,
    CASE WHEN k = 99 THEN '' ELSE md5(source_name || '|' || sha256 || '|' || action || '|' || file_format) END AS kafka_key,
    date_trunc('day', ts) AS source_ts,
    'ref.' || source_name || '.' || (user_id % 20) AS track_ref,
    'lnk.' || (user_id % 13) || '.' || (k % 17) AS track_link,
    'plugin.' || author_name || '.' || author_version AS track_author,
    'plugin.step' || (k % 11) || '.v1' AS track_author2,
    kafka_key || '.' || author_name || '.' || author_version || '.' || CAST(floor(epoch(ts)) AS BIGINT) AS dequeued,
    CASE WHEN user_id % 3 = 0 THEN 'User' ELSE 'plugin' END AS author_category,
    CASE WHEN k % 4 <> 0 THEN 'completed' WHEN k % 8 = 0 THEN 'failed' ELSE 'heartbeat' END AS status
  FROM events)
"""


def sql(body: str, *views: str) -> str:
    """A query over the adapted rows, with further views in front."""
    return "WITH " + ", ".join([SQL.strip(), *views]) + "\n" + body.strip()
