"""Registered queries against their SQL, at the smallest scale.

The default is one query of each kind; RELAYGRID_ALL=1 runs all of them.
"""

import os

import pytest

from oracle import connect, differences
from relaygrid import catalog

SF = "/root/testdata/sf0.001"


SAMPLE = (
    "ageoff", "artifact_copies", "blob_copy", "blob_delete_remaining", "bounded_first_seen", "compacted_view", "consume_active",
    "consume_passive", "consumer_match_matrix", "drop_undecodable", "explode_results", "fetch_active", "fetch_from_log",
    "fetch_info", "identity_key", "inject_children", "inject_stream", "judge_purged", "latest_registrations", "live_plus_historic", "lost_task_stream", "lost_tasks",
    "page", "pause_gate", "produce_user_stages", "publish_plan", "publish_stats", "purge_stream", "replay_completions", "replay_stream_results", "reprocess_stream", "retention", "throttled_pause_stream", "throttled_pauses",
    "validate_consumers",
)
NAMES = sorted(catalog.checks()) if os.environ.get("RELAYGRID_ALL") else SAMPLE


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    only_spark, only_sql, _ = differences(spark, SF, name, con)
    assert not only_spark and not only_sql, (only_spark, only_sql)


def test_every_query_has_a_check():
    assert set(catalog.queries()) == set(catalog.checks())
