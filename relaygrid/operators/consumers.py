"""Consumer specs: building, validating, registering, matching."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relaygrid import schemas
from relaygrid import vocabulary as V
from relaygrid.functions import content as C
from relaygrid.functions import identity, routing
from relaygrid.functions.messages import flag
from relaygrid.operators import filters, signature
from relaygrid.operators.filters import instant
from relaygrid.session import settle


@dataclass(frozen=True)
class ConsumerSpec:
    """What one consumer wants; the literal form of a consumer row."""

    name: str
    version: str = ""
    model: str = "binary"
    deployment_key: str = ""
    count: int = V.FETCH_DEFAULT
    deadline: int = V.DEADLINE_DEFAULT_S
    is_task: bool = False
    debug: bool = False
    require_sources: list[str] = field(default_factory=list)
    require_events: list[str] = field(default_factory=list)
    deny_events: list[str] = field(default_factory=list)
    require_content: bool = False
    require_streams: dict[str, list[str]] = field(default_factory=dict)
    require_under_content_size: int = 0
    require_over_content_size: int = 0
    require_expedite: bool = False
    require_live: bool = True
    require_historic: bool = False
    deny_self: bool = False
    max_security: str = ""

    def column(self) -> Column:
        types = {f.name: f.dataType for f in schemas.CONSUMER.fields}
        parts = []
        for f in fields(self):
            value = getattr(self, f.name)
            if isinstance(value, dict):
                entries = [c for k, v in value.items() for c in (F.lit(k), _strings(v))]
                literal = F.create_map(*entries)
            elif isinstance(value, list):
                literal = _strings(value)
            else:
                literal = F.lit(value)
            parts.append(literal.cast(types[f.name]).alias(f.name))
        return F.struct(*parts)


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def spec_column(df: DataFrame, prefix: str = "") -> Column:
    """Consumer struct from the columns of a consumer table."""
    return F.struct(*[F.col(f"{prefix}{f.name}").alias(f.name) for f in schemas.CONSUMER.fields])


def validate_consumers(raw: DataFrame) -> DataFrame:
    """Query parameters to consumer rows, with ``error`` where they are bad.

    Input: one row per request with string columns (absent = NULL) and array
    columns ``require_sources, require_actions, deny_actions, require_streams``.
    """
    flags = ["require_expedite", "require_live", "require_historic", "is_task", "require_content", "deny_self", "debug"]
    numbers = {"count": V.FETCH_DEFAULT, "deadline": V.DEADLINE_DEFAULT_S,
               "require_under_content_size": 0, "require_over_content_size": 0}
    parsed = raw
    for name in flags:
        parsed = parsed.withColumn(f"_{name}", C.parse_flag(F.col(name)))
    for name, default in numbers.items():
        parsed = parsed.withColumn(f"_{name}", C.parse_count(F.col(name), default))
    asked = F.coalesce(F.col("require_actions"), F.array().cast("array<string>"))
    denied = F.coalesce(F.col("deny_actions"), F.array().cast("array<string>"))
    known = _strings(V.ACTIONS)
    under, over = F.col("_require_under_content_size"), F.col("_require_over_content_size")

    def bad(name: str) -> Column:
        return F.when(F.col(f"_{name}").isNull(), f"bad parameter for {name}")

    any_feed = F.col("_require_expedite") | F.col("_require_live") | F.col("_require_historic")
    error = F.coalesce(
        F.when(~F.col("model").isin(*V.MODELS), "not a registered model type"),
        bad("require_expedite"),
        F.when((F.col("model") != "binary") & F.col("_require_expedite"), "can only expedite binary events"),
        bad("require_live"), bad("require_historic"),
        F.when(~any_feed, "requires at least one of expedite, live or historic"),
        bad("count"), bad("deadline"), bad("is_task"),
        bad("require_under_content_size"), bad("require_over_content_size"),
        F.when((under > 0) & (over > under), "minimum content size above maximum"),
        bad("require_content"),
        F.when(F.col("_require_content") & ((F.size(asked) > 0) | (F.size(denied) > 0)), "cannot combine actions with content"),
        F.when(F.size(F.array_except(asked, known)) > 0, "unknown required action"),
        F.when(F.size(F.array_except(denied, known)) > 0, "unknown denied action"),
        bad("deny_self"), bad("debug"),
    )
    count = (
        F.when(F.col("_count") <= 0, V.FETCH_DEFAULT).when(F.col("_count") > V.FETCH_LIMIT, V.FETCH_LIMIT)
        .otherwise(F.col("_count"))
    )
    values = {
        **{name: F.col(f"_{name}") for name in flags},
        **{name: F.col(f"_{name}") for name in numbers},
        "count": count,
        "require_events": F.when(F.col("_require_content"), _strings(V.ACTIONS_WITH_CONTENT)).otherwise(asked),
        "deny_events": denied,
        "require_sources": F.coalesce(F.col("require_sources"), F.array().cast("array<string>")),
        "require_streams": C.parse_stream_requirements(
            F.coalesce(F.col("require_streams"), F.array().cast("array<string>"))
        ),
    }
    outputs = [
        values.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name)
        for f in schemas.CONSUMER.fields
    ]
    kept = [c for c in raw.columns if c not in {f.name for f in schemas.CONSUMER.fields}
            and c not in ("require_actions", "deny_actions")]
    return parsed.select(*kept, *outputs, error.alias("error"))


def latest_registrations(requests: DataFrame, now, ttl_s: int = V.REGISTRATION_TTL_S) -> DataFrame:
    """Newest spec per consumer key among the requests of the last 24 hours.

    ``requests`` holds the consumer columns, ``requested_at`` and unique ``seq``.
    """
    age = F.unix_micros(instant(now)) - F.unix_micros("requested_at")
    keyed = requests.where((age >= 0) & (age < ttl_s * 1_000_000)).withColumn(
        "consumer_key", identity.consumer_key(spec_column(requests))
    )
    # a time and a unique number as one number: positions are found without sorting specs
    position = F.unix_micros("requested_at").cast("decimal(19,0)") * F.lit(10**18).cast("decimal(19,0)") + F.col("seq").cast("decimal(19,0)")
    newest = keyed.groupBy("consumer_key").agg(F.max(position.cast("decimal(38,0)")).alias("_position"))
    last = newest.select((F.col("_position") % F.lit(10**18).cast("decimal(19,0)")).cast("bigint").alias("seq"))
    rows = keyed.join(settle(last, "last-registrations"), "seq", "left_semi")
    return rows.select("consumer_key", "requested_at", "seq", spec_column(requests).alias("spec")).select("consumer_key", "requested_at", "seq", "spec.*")


def deployments(registrations: DataFrame) -> DataFrame:
    """Deployment key to the consumer prefix it last registered."""
    keyed = registrations.where(F.coalesce(F.col("deployment_key"), F.lit("")) != "")
    prefix = identity.consumer_prefix(spec_column(registrations))
    return keyed.groupBy("deployment_key").agg(
        F.max_by(prefix, F.struct("requested_at", "seq")).alias("consumer_prefix")
    )


def subscriptions(
    consumers: DataFrame, naming: routing.Naming = routing.DEFAULT_NAMING, carry: list[str] | None = None
) -> DataFrame:
    """The feeds each consumer reads, best first: expedite, live, historic."""
    spec = spec_column(consumers)
    binary = spec["model"] == "binary"
    key = identity.consumer_key(spec)
    own = F.when(
        binary, routing.binary_topic_pattern_expr(spec["require_sources"], spec["require_events"], naming)
    ).otherwise(_quoted_system(spec["model"], naming))

    def feed(name: str, priority: int, start: str, pattern: Column, wanted: Column) -> Column:
        row = F.struct(
            F.lit(name).alias("feed"), F.lit(priority).alias("priority"), F.lit(start).alias("start"),
            pattern.alias("pattern"),
            F.concat(F.lit(f"{naming.root}-"), key, F.lit(f"-{name}")).alias("consumer_group"),
        )
        return F.when(flag(wanted), row)

    feeds = F.array_compact(F.array(
        feed("expedite", 0, "latest", F.lit(routing.exact_topic_pattern(naming.expedite)), binary & spec["require_expedite"]),
        feed("live", 1, "latest", own, spec["require_live"]),
        feed("historic", 2, "earliest", own, spec["require_historic"]),
    ))
    kept = ["consumer_key", "name", "version", "model", *(carry or [])]
    return consumers.withColumn("consumer_key", key).select(*kept, F.explode(feeds).alias("f")).select(*kept, "f.*")


def _quoted_system(model: Column, naming: routing.Naming) -> Column:
    head = routing.exact_topic_pattern(naming.system(""))[:-1]
    return F.concat(F.lit(head), model, F.lit("$"))


#: What a rule may say of an event, by its code; the first is that nothing speaks against it.
_TRIGGERS = (
    None, f"{V.STAGE_DEPTH}-{V.TOO_DEEP}",
    *[f"{V.STAGE_RULES}-{reason}" for reason in (
        V.REJECT_SOURCE, V.REJECT_EVENT_TYPE, V.REJECT_SELF, V.REJECT_TOO_LARGE, V.REJECT_TOO_SMALL, V.REJECT_FILE_FORMAT,
        V.REJECT_STREAM, V.REJECT_NO_CONTENT,
    )],
)
#: Content sizes that events are told apart by; where rules name more, every size is kept as it is.
_MOST_BOUNDS = 100


def consumer_match_matrix(
    events: DataFrame, consumers: DataFrame, carry: list[str], max_depth: int = V.DEPTH_PASSIVE,
    per_block: int = 500,
) -> DataFrame:
    """For every event and registered consumer: would it be dropped, and why.

    The registry is packed into blocks of about ``per_block`` specs.  Rules are
    judged once per signature of events (:mod:`relaygrid.operators.signature`)
    and spec; a signature keeps one byte per spec of a block.  Of an event only
    ``carry`` and its signature move, dealt evenly whatever the files it came
    in; it meets each block's bytes and unpacks them in place.  A registry of
    any size works.  The output has one row per pair because that is the
    question; roll it up before writing when only counts are wanted.
    """
    registry = settle(
        consumers.select(spec_column(consumers).alias("spec")), "consumers"
    )
    blocks = max(1, -(-registry.count() // per_block))
    block = F.pmod(F.xxhash64(F.col("spec.name"), F.col("spec.version"), F.to_json("spec")), F.lit(blocks))
    named = F.struct(
        F.col("spec.name").alias("name"), F.col("spec.version").alias("version"), identity.consumer_key(F.col("spec")).alias("key"))
    packed = settle(registry.groupBy(block.cast("int").alias("_block")).agg(
        F.collect_list(F.struct("spec", named.alias("named"))).alias("_specs")), "consumer-blocks")

    limits = signature.few_bounds(registry, _MOST_BOUNDS)
    parts = 4 * events.sparkSession.sparkContext.defaultParallelism
    seen = F.struct(*signature.seen(events, limits, max_depth)).alias("_seen")
    narrow = settle(events.select(*carry, seen).repartition(parts), "matrix-events")
    marks = narrow.select("_seen").distinct().withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = marks.join(packed.select("_block", F.col("_specs.spec").alias("_specs")), "_block").select("_seen", "_block", "_specs", "_seen.*")
    met = met.select("_seen", "_block", "_specs", "deep", *signature.as_message(True, "entity" in events.columns))

    def code(spec: Column) -> Column:
        said = F.concat(F.lit(f"{V.STAGE_RULES}-"), filters.consumer_rules(met, spec))
        place = F.array_position(F.array(*[F.lit(t) for t in _TRIGGERS[1:]]), said)
        known = F.when(place > 0, place).otherwise(F.raise_error(F.concat(F.lit("not among the triggers: "), said)).cast("long"))
        return F.when(F.col("deep"), F.lit(1)).when(said.isNull(), F.lit(0)).otherwise(known).cast("tinyint")

    judged = settle(met.select("_seen", "_block", F.transform("_specs", code).alias("_codes")), "matrix-judged")
    pairs = narrow.join(judged, "_seen").join(packed.select("_block", F.col("_specs.named").alias("_named")), "_block").select(
        *carry, "_codes", F.posexplode("_named").alias("_at", "_consumer"))
    trigger = F.get(F.array(*[F.lit(t).cast("string") for t in _TRIGGERS]), F.get("_codes", F.col("_at")).cast("int"))
    return pairs.select(
        *carry, F.col("_consumer.name").alias("consumer_name"), F.col("_consumer.version").alias("consumer_version"),
        F.col("_consumer.key").alias("consumer_key"), trigger.alias("filter_out_trigger"),
    ).withColumn("filter_out", F.col("filter_out_trigger").isNotNull())
