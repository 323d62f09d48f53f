"""The rolled-up matrix equals the matrix, and both sides have shrunk before they meet."""

import pytest
from pyspark.sql import functions as F

from relaygrid.catalog import adapter as A
from relaygrid.catalog.lookups import _registry
from relaygrid import vocabulary as V
from relaygrid.functions import identity
from relaygrid.operators import consumers, filters, rule_index
from relaygrid.operators.consumers import ConsumerSpec, consumer_match_matrix, spec_column

SF = "/root/testdata/sf0.001"


def counted(df):
    keys = ["consumer_key", "consumer_name", "consumer_version", "filter_out_trigger", "filter_out"]
    return sorted((tuple(r) for r in df.select(*keys, "n", "seqs").collect()), key=repr)


def rolled(events, specs):
    matrix = consumer_match_matrix(events, specs, carry=["seq"])
    keys = ["consumer_key", "consumer_name", "consumer_version", "filter_out_trigger", "filter_out"]
    return counted(matrix.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("seq").alias("seqs")))


def specs_of(spark, specs):
    one = spark.range(1)
    rows = None
    for spec in specs:
        row = one.select(spec.column().alias("s")).select("s.*")
        rows = row if rows is None else rows.unionByName(row)
    return rows


SPECS = [
    ConsumerSpec("any", "1"), ConsumerSpec("other", "1"), ConsumerSpec("plugin1", "1", deny_self=True), ConsumerSpec("plugin2", "1", deny_self=True),
    ConsumerSpec("a", "1", require_sources=["src1", "src0", "src1"], deny_events=["mapped"]),
    ConsumerSpec("b", "1", require_sources=["src0", "src1"], deny_events=["mapped"]),
    ConsumerSpec("c", "1", require_sources=["nowhere"]), ConsumerSpec("d", "1", require_events=["sourced"], require_content=True),
    ConsumerSpec("e", "1", require_under_content_size=500, require_over_content_size=300), ConsumerSpec("f", "1", require_over_content_size=301),
    ConsumerSpec("g", "1", require_streams={"content": ["executable/"], "text": []}), ConsumerSpec("h", "1", require_streams={"*": []}),
]


def test_rollup_of_binaries_and_statuses(spark):
    """Statuses are judged by their input, without content rules; other models pass."""
    events = A.mixed(spark, SF)
    events = events.withColumn("model", F.when(F.col("seq") % 50 == 7, "plugin").otherwise(F.col("model")))
    specs = specs_of(spark, SPECS)
    got = counted(rule_index.consumer_match_rollup(events, specs, {"seqs": F.col("seq")}))
    assert got == rolled(events, specs)
    assert len({r[3] for r in got}) >= 8


def test_equal_rules_are_one_class(spark):
    specs = specs_of(spark, SPECS)
    named = specs.select("name", rule_index.rule_class(spec_column(specs)).alias("class")).collect()
    of = {r["name"]: r["class"] for r in named}
    assert of["any"] == of["other"] and of["a"] == of["b"]
    assert len(set(of.values())) == len(SPECS) - 2


def test_sizes_count_by_the_bounds_they_lie_between(spark):
    """As many signatures as the rules can tell apart, however many sizes there are."""
    events = A.messages(spark, SF)
    registry = specs_of(spark, SPECS).select(F.struct("*").alias("spec"))
    keyed = registry.withColumn("consumer_key", identity.consumer_key(F.col("spec"))).withColumn("class", rule_index.rule_class(F.col("spec")))
    limits = rule_index.bounds(rule_index.classes(keyed))
    assert limits == [300, 301, 500]
    places = rule_index.signatures(events, limits, {}, 11).select(F.explode("streams").alias("s")).where("s.label = 'content'").select("s.size").distinct()
    assert {r["size"] for r in places.collect()} <= {299, 300, 301, 302, 500, 501}


def test_nothing_to_match(spark):
    specs, events = specs_of(spark, SPECS), A.messages(spark, SF)
    assert rule_index.consumer_match_rollup(events.where("false"), specs).isEmpty()
    assert rule_index.consumer_match_rollup(events, specs.where("false")).isEmpty()


def test_registry_of_the_tables(spark):
    events, specs = A.messages(spark, SF), _registry(spark, SF)
    assert counted(rule_index.consumer_match_rollup(events, specs, {"seqs": F.col("seq")})) == rolled(events, specs)


def judged_one_by_one(events, specs):
    pairs = events.crossJoin(specs.select(spec_column(specs).alias("spec")))
    said = F.concat(F.lit(f"{V.STAGE_RULES}-"), filters.consumer_rules(pairs, F.col("spec")))
    deep = F.concat(F.lit(f"{V.STAGE_DEPTH}-"), filters.too_deep(pairs, V.DEPTH_PASSIVE))
    found = pairs.select("seq", "spec.name", identity.consumer_key(F.col("spec")), F.coalesce(deep, said).alias("trigger"))
    return sorted(map(tuple, found.collect()), key=repr)


@pytest.mark.parametrize("case", ["mixed", "nulls", "many bounds", "no entity"])
def test_matrix_judges_signatures_not_pairs(spark, monkeypatch, case):
    """As each pair judged alone; no rule and no lineage is left where events meet consumers."""
    events = A.mixed(spark, SF).where("seq % 4 = 0")
    events = events.withColumn("model", F.when(F.col("seq") % 50 == 8, "plugin").otherwise(F.col("model")))
    # rows that come twice, and consumers that are registered twice
    events = events.unionByName(events.where("seq < 40"))
    specs = specs_of(spark, [*SPECS, SPECS[-2]])
    if case == "nulls":
        holes = {"model": 11, "source": 7, "action": 5, "author": 6, "entity": 9}
        for name, n in holes.items():
            events = events.withColumn(name, F.when(F.col("seq") / 4 % n != 1, F.col(name)))
        loose = F.transform("entity.datastreams", lambda s: F.when(s["size"] % 5 > 0, s.withField("label", F.when(s["size"] % 7 > 0, s["label"]))))
        events = events.withColumn("entity", F.col("entity").withField("datastreams", loose))
    if case == "many bounds":
        monkeypatch.setattr(consumers, "_MOST_BOUNDS", 2)
    if case == "no entity":
        events = events.drop("entity")
    got = consumer_match_matrix(events, specs, carry=["seq"], per_block=4)
    rows = got.select("seq", "consumer_name", "consumer_key", "filter_out_trigger").collect()
    assert sorted(map(tuple, rows), key=repr) == judged_one_by_one(events, specs)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and "path" not in plan
