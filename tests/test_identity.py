import copy

import pytest
from pyspark.sql import functions as F

from builders import binary, frame, statuses
from relaygrid import schemas
from relaygrid.functions.identity import consumer_key, identity_expr, identity_key
from relaygrid.operators.consumers import ConsumerSpec

# --- fixed values: one submission with four lineage nodes and its known keys ---
SHA_A = "b9debe8afbdc6d0f552ca4d41fc8a5760778f2724d1560f6b4b0fc28bd837a82"
SHA_B = "ee303d3c6d7cfa24d42e6348bdd1103a26de77a887e9dbee3dd1fe6304414f69"
NODES = [
    ("vtfileloader", "sourced", SHA_A + "-1612629803"), ("vtselect", "sourced", SHA_A),
    ("vtdownload", "sourced", SHA_A), ("MimeDecoder", "extracted", SHA_B),
]
REFERENCES = {
    "interface": "web", "submitter_city": "kharkiv", "submitter_country": "UA",
    "submitter_id": "0a9e3094", "submitter_region": "63",
}
PLAIN = "e299c2cfa5345f98ea34ff0455de22b7"


def simple():
    return binary(
        source={
            "name": "virustotal", "timestamp": "2021-02-06T16:43:23Z", "references": dict(REFERENCES),
            "path": [{"author": {"name": n, "version": "1.1"}, "action": a, "sha256": s} for n, a, s in NODES],
        },
        action="extracted",
    )


def _source_security(e):
    e["source"]["security"] = "RESTRICTED"


def _path_security(e):
    for i, node in enumerate(e["source"]["path"]):
        node["author"]["security"] = "RESTRICTED" if i == 0 else "PROVIDED"


def _reference(e):
    e["source"]["references"]["submitter_id"] = "xxxxxxxx"


def _author(e):
    e["source"]["path"][-1]["author"]["name"] = "SlimeDecoder"


def _reordered(e):
    e["source"]["references"] = dict(sorted(REFERENCES.items(), reverse=True))


def _existing_key(e):
    e["kafka_key"] = "something"


def _version(e):
    e["source"]["path"][-1]["author"]["version"] = "9"


def _first_ancestor(e):
    e["source"]["path"][0]["author"]["name"] = "another"


@pytest.mark.parametrize("change, key", [
    (lambda e: None, PLAIN), (_reordered, PLAIN), (_existing_key, PLAIN), (_version, PLAIN), (_first_ancestor, PLAIN),
    (_source_security, "6c5f818d929c8db4ae0cc1f36dc14867"), (_path_security, "e568cb3839f4d866a583fcff6409b742"),
    (_reference, "34bc6c679cf84bd88d9fbfe7c7d2f873"), (_author, "006648451545351e9f8a11d40d601f18"),
])
def test_binary_keys(spark, change, key):
    event = copy.deepcopy(simple())
    change(event)
    assert identity_key(frame(spark, [event])).first().kafka_key == key


def test_binary_without_lineage_is_dropped(spark):
    event = simple()
    event["source"]["path"] = []
    assert identity_key(frame(spark, [event, simple()])).count() == 1


def test_clock_of_raw_text_keeps_its_offset(spark):
    df = frame(spark, [simple()])
    from relaygrid.functions.identity import wall_clock

    utc = df.select(identity_expr(df).alias("k")).first().k
    raw = df.select(identity_expr(df, wall_clock(F.lit("2021-02-06T16:43:23+11:00"))).alias("k")).first().k
    assert utc == raw == PLAIN


def test_other_models(spark):
    status = {"author": {"name": "MimeDecoder"}, "entity": {"status": "completed", "input": binary(dequeued="abc.p.1.5")}}
    got = identity_key(statuses(spark, [status])).first().kafka_key
    assert got == spark.sql("select md5('abc.p.1.5.MimeDecoder')").first()[0]
    # fixed value: key of this plugin name and version
    plugin = {"author": {"name": "RatConfigs-JRat"}, "entity": {"name": "RatConfigs-JRat", "version": "2020.06.02"}}
    df = frame(spark, [plugin], schemas.PLUGIN, "plugin").withColumnRenamed("entity", "plugin")
    assert identity_key(df).first().kafka_key == "68e3d23d6ab9facfbd4e3d5f7543c636"
    insert = {"entity": {"parent_sha256": "p", "child": {"sha256": "c"}, "child_history": {"author": {"name": "u"}}}}
    df = frame(spark, [insert], schemas.INSERT, "insert").withColumnRenamed("entity", "insert")
    assert identity_key(df).first().kafka_key == spark.sql("select md5('p.c.u')").first()[0]
    other = frame(spark, [{"action": "ids"}] * 2, schemas.DELETE, "delete")
    assert identity_key(other).select("kafka_key").distinct().count() == 2


@pytest.mark.parametrize("spec, key", [
    (ConsumerSpec("myplugin", "0.1.0", "status", require_live=True, require_historic=True), "myplugin-0.1.0-status-LH"),
    (ConsumerSpec("myplugin", "0.1.0", "status", require_live=True), "myplugin-0.1.0-status-L"),
    (ConsumerSpec("myplugin", "0.1.0", require_expedite=True, require_live=True, require_historic=True), "myplugin-0.1.0-binary-allsrc-alltype-ELH"),
    (ConsumerSpec("myplugin", "0.1.0", require_expedite=True, require_live=True), "myplugin-0.1.0-binary-allsrc-alltype-EL"),
    (ConsumerSpec("myplugin", "1.0.0", require_expedite=True, require_live=True, require_sources=["tasking"]), "myplugin-1.0.0-binary-tasking-alltype-EL"),
    (ConsumerSpec("myplugin", "1.0.0", require_live=False, require_historic=True, require_sources=["tasking"]), "myplugin-1.0.0-binary-tasking-alltype-H"),
    (ConsumerSpec("myplugin", "1.0.0", require_expedite=True, require_live=True, require_historic=True, require_sources=["tasking"],
                  require_events=["sourced", "extracted", "augmented"]), "myplugin-1.0.0-binary-tasking-sourced.extracted.augmented-ELH"),
    (ConsumerSpec("myplugin", "1.0.0", "status", require_live=False, debug=True), "myplugin-1.0.0-status-D"),
])
def test_consumer_keys(spark, spec, key):
    assert spark.range(1).select(consumer_key(spec.column()).alias("k")).first().k == key


def test_a_scan_reads_only_the_leaves_it_needs(spark):
    from relaygrid.operators.filters import too_deep
    from relaygrid.session import settle

    stored = settle(frame(spark, [simple()]), "messages")
    keyed = identity_key(stored).select("kafka_key")
    assert keyed.first().kafka_key == PLAIN
    scan = keyed._jdf.queryExecution().executedPlan().toString()
    for unread in ("relationship", "filename", "datastreams", "features"):
        assert unread not in scan
    scan = stored.select(too_deep(stored, 4))._jdf.queryExecution().executedPlan().toString()
    assert "path:array<struct<sha256:string>>" in scan.replace(",action", "") and "relationship" not in scan
