import pytest

from builders import binary, frame, kept, path_of, statuses
from relaygrid import schemas, vocabulary as V
from relaygrid.operators import filters
from relaygrid.operators.consumers import ConsumerSpec


def stream(label="content", size=1024, file_format="text/plain"):
    return {"label": label, "size": size, "file_format": file_format}


def with_streams(*streams, **changes):
    return binary(entity={"sha256": "aa", "datastreams": list(streams)}, **changes)


SIZED = [
    with_streams(action="enriched", source={"name": "mysource"}),
    with_streams(stream(size=100)), with_streams(stream(size=1000)),
    with_streams(stream(size=10000), action="extracted"),
    with_streams(stream(size=10000), stream("pcap", 100), action="augmented"),
]
TYPED = [
    with_streams(stream(file_format="executable/windows/pe32")), with_streams(stream(file_format="executable/windows/dll32")),
    with_streams(stream(file_format="executable/windows/dll64")), with_streams(stream()),
    with_streams(stream(file_format="executable/windows/pe32"), stream("safe_png", file_format="image/png")),
]
PCAP = [
    *TYPED[:4],
    with_streams(stream(file_format="executable/windows/pe32"), stream("pcap", file_format="network/tcpdump")),
]
NAMED = [with_streams(stream(), author={"name": n}) for n in ("test", "tester", "intest", "apple", "test")]
PE = ["executable/windows/pe32", "executable/windows/dll32"]


@pytest.mark.parametrize("events, wants, survivors", [
    (SIZED, {"require_under_content_size": 1020}, [1, 2]),
    (SIZED, {"require_under_content_size": 1020, "require_over_content_size": 1000}, [2]),
    (SIZED, {"require_over_content_size": 2000}, [3, 4]),
    (SIZED, {"require_events": ["extracted", "augmented"]}, [3, 4]),
    (SIZED, {"require_sources": ["testing"], "require_events": ["sourced"]}, [1, 2]),
    (SIZED, {"deny_events": ["mapped", "enriched"]}, [1, 2, 3, 4]),
    (SIZED, {"require_content": True}, [1, 2, 3, 4]),
    (NAMED, {"deny_self": True}, [1, 2, 3]),
    (TYPED, {"require_streams": {"*": PE}}, [0, 1]),
    (PCAP, {"require_streams": {"content": [], "pcap": ["network/tcpdump"]}}, [4]),
    (TYPED, {"require_streams": {"content": PE}}, [0, 1]),
    (TYPED, {"require_streams": {"content": ["executable/"]}}, [0, 1, 2]),
    # no streams at all passes when one label is required
    ([with_streams()], {"require_streams": {"content": []}}, [0]),
    # bounds are inclusive
    ([with_streams(stream(size=10))], {"require_under_content_size": 10, "require_over_content_size": 10}, [0]),
])
def test_consumer_rules(spark, events, wants, survivors):
    df = frame(spark, events)
    assert kept(df, filters.consumer_rules(df, ConsumerSpec("test", "5", **wants).column())) == survivors


def test_first_violated_rule_wins(spark):
    df = frame(spark, [with_streams(stream(size=5000, file_format="x"), source={"name": "other"})])
    spec = ConsumerSpec("generic", require_sources=["testing"], deny_self=True, require_under_content_size=10)
    assert df.select(filters.consumer_rules(df, spec.column()).alias("r")).first().r == V.REJECT_SOURCE


def test_statuses_are_judged_by_their_input(spark):
    df = statuses(spark, [{"author": {"name": "x"}, "entity": {"input": binary(action="mapped")}}])
    spec = ConsumerSpec("t", deny_events=["mapped"])
    assert df.select(filters.consumer_rules(df, spec.column()).alias("r")).first().r == V.REJECT_EVENT_TYPE
    spec = ConsumerSpec("t", require_under_content_size=1)
    assert df.select(filters.consumer_rules(df, spec.column()).alias("r")).first().r is None


@pytest.mark.parametrize("n, reason", [(0, None), (4, None), (5, V.TOO_DEEP), (9, V.TOO_DEEP)])
def test_too_deep(spark, n, reason):
    df = frame(spark, [binary(source={"name": "s", "path": path_of(n)})])
    assert df.select(filters.too_deep(df, 4).alias("r")).first().r == reason


def test_ageoff(spark):
    def at(day, name="timed"):
        return binary(source={"name": name, "timestamp": f"2024-01-{day:02d}T00:00:00Z"})

    df = frame(spark, [at(1), at(10), at(12), at(8), at(1, "keeps"), at(1, "unknown"), at(9)])
    sources = spark.createDataFrame([("timed", 2 * 86_400_000), ("keeps", 0)], schemas.SOURCES)
    dated = filters.with_expiry(df, sources)
    # exactly at the expiry instant is still kept
    assert kept(dated, filters.ageoff(dated, "2024-01-11 00:00:00")) == [1, 2, 4, 5, 6]
