import re

import corpus_pipeline
from brute import near_groups
from pyspark.sql import functions as F
from samples import docs

from relaygrid.llm import near_dedup, quality
from relaygrid.llm.common import read
from relaygrid.session import settle

SF = "/root/testdata/sf0.001"


def test_stages_work_on_all_that_their_predecessors_keep(spark):
    frame = read(spark, SF, "documents")
    columns = frame.columns
    texts = {}
    for name, stage in corpus_pipeline.STAGES:
        before = frame
        frame = settle(stage(spark, before, SF), "test-stage")
        if name != "packing":
            assert frame.columns == columns
        texts[name] = [(r["doc_id"], r["text"]) for r in frame.collect()] if name != "packing" else frame.collect()
    docs_ = read(spark, SF, "documents")
    good = {r["doc_id"] for r in quality.quality(docs_, read(spark, SF, "labels")).where("predicted = 1").collect()}
    assert {i for i, _ in texts["quality classifier"]} == good
    groups = {}
    for i, t in texts["quality classifier"]:
        groups.setdefault(re.sub("[\x20\x09-\x0d]+", " ", t), []).append(i)
    assert sorted(i for i, _ in texts["exact dedup"]) == sorted(min(v) for v in groups.values())
    near = near_groups(texts["exact dedup"], 5)
    assert sorted(i for i, _ in texts["near dedup"]) == sorted(i for i, (_, c) in near.items() if c == i)
    words = {i: len((t or "").split()) for i, t in texts["near dedup"]}
    mixed = sum(len((t or "").split()) for _, t in texts["mixing"])
    assert abs(mixed - 1.5 * sum(words.values())) < 64 * 30
    lengths = [r["length"] for r in texts["packing"]]
    assert len({r["sequence_id"] for r in texts["packing"]}) <= sum(lengths) // 2048 + 2
    assert {r["doc_id"] for r in texts["packing"]} == {i for i, _ in texts["mixing"]}


def test_run_is_the_stages_in_turn(spark):
    frame = read(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES:
        frame = settle(stage(spark, frame, SF), "test-stage")
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).select(key).collect())) == sorted(map(tuple, frame.select(key).collect()))


def test_stages_on_odd_and_empty_tables(spark):
    for frame in (docs(spark), docs(spark).limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = settle(stage(spark, frame, SF), "test-stage")
            if name != "packing":
                assert out.columns == frame.columns
                frame = out
    assert near_dedup.near_dedup(docs(spark).where(F.lit(False))).count() == 0
