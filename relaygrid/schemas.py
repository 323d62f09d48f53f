"""Explicit schemas; nothing is ever inferred."""

from pyspark.sql.types import (
    ArrayType, BooleanType, DataType, DoubleType, IntegerType, LongType, MapType, StringType,
    StructField, StructType, TimestampNTZType, TimestampType,
)

STR, INT, LONG, DBL, BOOL, TS = (
    StringType(), IntegerType(), LongType(), DoubleType(), BooleanType(), TimestampType(),
)
STRINGS = ArrayType(STR)
TEXT_MAP = MapType(STR, STR)


def struct(**fields: DataType) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields.items()])


def texts(*names: str) -> dict[str, DataType]:
    return dict.fromkeys(names, STR)


AUTHOR = struct(**texts("name", "version", "category", "security"))
NODE = struct(
    author=AUTHOR, action=STR, sha256=STR, relationship=TEXT_MAP, timestamp=TS, file_format=STR, size=LONG, filename=STR,
)
STREAM = struct(
    identify_version=INT, label=STR, size=LONG,
    **texts("sha512", "sha256", "sha1", "md5", "ssdeep", "tlsh", "mime", "magic", "file_format", "file_extension", "language"),
)
FEATURE = struct(**texts("name", "value", "type", "label"))
ENTITY = struct(
    **texts("sha256", "sha512", "sha1", "md5"), size=LONG, **texts("mime", "magic", "file_format", "file_extension"),
    features=ArrayType(FEATURE), datastreams=ArrayType(STREAM), info=STR,
)
SOURCE = struct(name=STR, security=STR, timestamp=TS, references=TEXT_MAP, settings=TEXT_MAP, path=ArrayType(NODE))
FLAGS = struct(bypass_cache=BOOL, expedite=BOOL, retry=BOOL)
HEADER = {"model_version": INT, "kafka_key": STR, "timestamp": TS, "author": AUTHOR}

BINARY = struct(
    **HEADER, source=SOURCE, action=STR, entity=ENTITY, flags=FLAGS, dequeued=STR, retries=INT,
    track_source_references=STR, track_links=STRINGS, track_authors=STRINGS,
)
STATUS_ENTITY = struct(input=BINARY, status=STR, runtime=DBL, error=STR, results=ArrayType(BINARY))
PLUGIN_ENTITY = struct(
    **texts("name", "version", "category", "contact", "description", "security"),
    features=ArrayType(struct(**texts("name", "type", "desc"))), config=TEXT_MAP,
)
INSERT_ENTITY = struct(original_source=STR, parent_sha256=STR, child=ENTITY, child_history=NODE)
DELETE_ENTITY = struct(
    reason=STR, ids=struct(ids=STRINGS), submission=struct(track_source_references=STR, timestamp=TS),
    link=struct(track_link=STR), author=struct(track_author=STR, timestamp=TS),
)
STATUS = struct(**HEADER, entity=STATUS_ENTITY)
PLUGIN = struct(**HEADER, entity=PLUGIN_ENTITY)
INSERT = struct(**HEADER, entity=INSERT_ENTITY, track_author=STR, track_link=STR)
DELETE = struct(**HEADER, action=STR, entity=DELETE_ENTITY)
DOWNLOAD = struct(
    **HEADER, action=STR, source=SOURCE, entity=struct(hash=STR, category=STR, category_quota=INT, metadata=STR),
)
BY_MODEL = {
    "binary": BINARY, "status": STATUS, "plugin": PLUGIN,
    "insert": INSERT, "delete": DELETE, "download": DOWNLOAD,
}

# One row per message: the binary fields at the top level, other payloads as
# nullable structs next to them.
MESSAGE_PAYLOADS = {
    "status": STATUS_ENTITY, "plugin": PLUGIN_ENTITY, "insert": INSERT_ENTITY, "delete": DELETE_ENTITY, "download": DOWNLOAD["entity"].dataType,
}

CONSUMER = struct(
    **texts("name", "version", "model", "deployment_key"), count=INT, deadline=INT, is_task=BOOL, debug=BOOL,
    require_sources=STRINGS, require_events=STRINGS, deny_events=STRINGS, require_content=BOOL,
    require_streams=MapType(STR, STRINGS), require_under_content_size=LONG, require_over_content_size=LONG,
    require_expedite=BOOL, require_live=BOOL, require_historic=BOOL, deny_self=BOOL, max_security=STR,
)
SOURCES = struct(source_name=STR, expire_ms=LONG)
TOPIC_POLICY = struct(topic=STR, cleanup=STR, retention_ms=LONG)
TOPIC_LOG = struct(topic=STR, partition=INT, offset=LONG, key=STR, value=STR, ts=TS)
OFFSETS = struct(consumer_group=STR, topic=STR, partition=INT, committed=LONG)
ACCESS_LOG = struct(
    time=STR, duration_s=STR, status=INT, **texts("method", "route", "path", "query", "remote", "user_agent"),
)
CONSUMER_ERROR_LOG = struct(
    **texts("time", "user_agent", "pipeline", "plugin", "version", "description", "error"), event_bytes=INT, event=STR,
)
PRODUCER_ERROR_LOG = struct(
    **texts("time", "user_agent", "pipeline", "description", "error"), event_bytes=INT, event=STR,
)
EVENTS_TABLE = struct(event_id=LONG, ts=TimestampNTZType(), user_id=LONG, event_type=STR, value=DBL, props=STR)
