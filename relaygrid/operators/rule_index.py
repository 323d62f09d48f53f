"""Rule index: which consumers a whole log would reach, without a row per event and consumer.

Both sides shrink before they meet.  Consumers with equal rules form one
*class*.  Events that the rules cannot tell apart form one *signature*; content
sizes count only by where they lie between the bounds some class names.  An
inverted index from source to classes, narrowed by the actions that occur
there, settles the routing rules per (source, action); only admitted classes
meet a signature, where the rules on sender and content speak.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relaygrid import vocabulary as V
from relaygrid.functions import identity
from relaygrid.functions.messages import flag, text
from relaygrid.operators import filters
from relaygrid.operators.consumers import spec_column
from relaygrid.operators.signature import as_message, bounds, seen
from relaygrid.session import settle


def rule_class(spec: Column) -> Column:
    """Name of the rules of a consumer; equal for equal rules, whatever their order."""

    def listed(values: Column) -> Column:
        return F.array_sort(F.array_distinct(F.coalesce(values, F.array().cast("array<string>"))))

    streams = F.transform(
        F.array_sort(F.map_keys(spec["require_streams"])), lambda label: F.struct(label, listed(spec["require_streams"][label])))
    # a consumer's own name matters only to one that does not want its own messages
    own = F.when(flag(spec["deny_self"]), text(spec["name"]))
    return F.md5(F.to_json(F.struct(
        listed(spec["require_sources"]), listed(spec["require_events"]), listed(spec["deny_events"]), flag(spec["require_content"]),
        streams, spec["require_under_content_size"], spec["require_over_content_size"], own.alias("own"),
    )))


def classes(registry: DataFrame) -> DataFrame:
    """One row per class: its name and a spec that stands for it."""
    return registry.groupBy("class").agg(F.min_by("spec", "consumer_key").alias("spec"))


def signatures(events: DataFrame, limits: list[int], sums: dict[str, Column], max_depth: int) -> DataFrame:
    """What the rules see of an event, with the number of such events and their sums."""
    return events.select(*seen(events, limits, max_depth), *[value.alias(c) for c, value in sums.items()]).groupBy(
        "model", "source_name", "action", "author_name", "streams", "deep").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in sums])


def consumer_match_rollup(
    events: DataFrame, consumers: DataFrame, sums: dict[str, Column] | None = None, max_depth: int = V.DEPTH_PASSIVE,
) -> DataFrame:
    """Per consumer and reason, how many events it would (not) get: :func:`consumers.consumer_match_matrix`, rolled up.

    ``sums`` adds sums over the events, by name.  A reason no event meets has no row.
    """
    sums = sums or {}
    totals = ["n", *sums]
    registry = consumers.select(spec_column(consumers).alias("spec")).withColumn("consumer_key", identity.consumer_key(F.col("spec")))
    registry = settle(registry.withColumn("class", rule_class(F.col("spec"))), "rule-registry")
    kinds = settle(classes(registry), "rule-classes")
    marks = settle(signatures(events, bounds(kinds), sums, max_depth), "rule-signatures")
    # the index: classes by the source they want, and those that want any
    ruled = F.col("model").isin("binary", "status") & ~F.col("deep")
    heads = settle(marks.where(ruled).groupBy("model", "source_name", "action").agg(*[F.sum(c).alias(c) for c in totals]), "rule-heads")
    wanted = F.array_distinct("spec.require_sources")
    under = F.when(F.size(wanted) > 0, F.transform(wanted, lambda source: F.concat(F.lit("="), source))).otherwise(F.array(F.lit("*")))
    postings = settle(kinds.select("class", "spec", F.explode(under).alias("posted")), "rule-postings")

    # routing rules, once per class and (source, action)
    asked = F.explode(F.array(F.concat(F.lit("="), text(F.col("source_name"))), F.lit("*")))
    posted = heads.withColumn("posted", asked).join(postings, "posted").select("class", "spec", "source_name", *totals, *as_message(False, False))
    routed = settle(posted.withColumn("said", filters.consumer_rules(posted, F.col("spec"))).drop("source", "author"), "rule-routed")
    turned_away = routed.where("said IS NOT NULL").groupBy("class", "said").agg(*[F.sum(c).alias(c) for c in totals])

    # sender and content rules, once per class and signature
    admitted = routed.where("said IS NULL").select("class", "spec", F.col("model").alias("_model"), F.col("source_name").alias("_source"), F.col("action").alias("_action"))
    same = (F.col("model") == F.col("_model")) & F.col("source_name").eqNullSafe(F.col("_source")) & F.col("action").eqNullSafe(F.col("_action"))
    met = marks.where(ruled).join(admitted, same).select("class", "spec", *totals, *as_message(True, True))
    judged = met.withColumn("said", filters.consumer_rules(met, F.col("spec"))).groupBy("class", "said").agg(*[F.sum(c).alias(c) for c in totals])

    # what the index did not post for a class, its sources turn away; depth and other models are the same for all
    rules = F.when(F.col("said").isNotNull(), F.concat(F.lit(f"{V.STAGE_RULES}-"), F.col("said")))
    decided = settle(turned_away.unionByName(judged).withColumn("reason", rules).drop("said"), "rule-decided")
    met_in_all = decided.groupBy("class").agg(*[F.sum(c).alias(f"_{c}") for c in totals])
    sides = {"ruled": ruled, "deep": F.col("deep"), "free": ~ruled & ~F.col("deep")}
    whole = marks.agg(*[F.sum(F.when(side, F.col(c))).alias(f"{c}_{name}") for c in totals for name, side in sides.items()]).first()
    kind = {c: marks.schema[c].dataType for c in totals}

    def of_all(c: str, side: str) -> Column:
        return F.lit(whole[f"{c}_{side}"]).cast(kind[c])

    def line(reason: str | None, side: str, known: bool) -> Column:
        left = [of_all(c, side) - F.coalesce(F.col(f"_{c}"), F.lit(0)) if known else of_all(c, side) for c in totals]
        return F.struct(F.lit(reason).cast("string").alias("reason"), *[value.cast(kind[c]).alias(c) for c, value in zip(totals, left, strict=True)])

    rest = kinds.select("class").join(met_in_all, "class", "left")
    lines = F.array(
        line(f"{V.STAGE_RULES}-{V.REJECT_SOURCE}", "ruled", True), line(f"{V.STAGE_DEPTH}-{V.TOO_DEEP}", "deep", False), line(None, "free", False))
    alike = rest.select("class", F.explode(lines).alias("l")).select("class", "l.*").where("n > 0")
    per_class = decided.unionByName(alike.select(*decided.columns)).groupBy("class", "reason").agg(*[F.sum(c).alias(c) for c in totals])
    return registry.select("class", "consumer_key", F.col("spec.name").alias("consumer_name"), F.col("spec.version").alias("consumer_version")).join(
        per_class, "class").select(
        "consumer_key", "consumer_name", "consumer_version", F.col("reason").alias("filter_out_trigger"), F.col("reason").isNotNull().alias("filter_out"), *totals)
