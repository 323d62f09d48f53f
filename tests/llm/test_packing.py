import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from samples import docs, empty, rows
from tokenizers import Tokenizer

from relaygrid.llm.packing import VOCABULARY, ChunkTokenizer, pack, places, plan

PIECES = ["a", "B", "É", "é", "ß", "'s", "'LL", "1", "٣", "ー", "İ", "é", "́", ".", ",!", "--", "\x1c", "\x85", "\xa0", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "日本", "Σ", "ς", "Ⅷ", " ", "\n", "\t", "\x0b"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=12))
def test_chunks_give_the_ids_of_whole_texts(parts):
    text = "".join(parts)
    ids = np.frombuffer(TOKENS.ids(text.encode()), "<u4").tolist()
    assert ids == WHOLE.encode(text, add_special_tokens=False).ids


TOKENS, WHOLE = ChunkTokenizer(cache=50), Tokenizer.from_file(VOCABULARY)


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_everything_once(seed):
    draw = random.Random(seed)
    counts = {}
    for _ in range(draw.choice([0, 1, 50, 3000])):
        length = min(100, int(draw.expovariate(1 / 30)) + 1) if seed % 2 else draw.randint(1, 100)
        counts[length] = counts.get(length, 0) + 1
    groups = plan(counts, 100)
    used = {}
    for many, content in groups:
        assert many > 0 and sum(length * each for length, each in content) <= 100
        assert sum(each for length, each in content if 3 * length > 100) <= 2
        for length, each in content:
            used[length] = used.get(length, 0) + many * each
    assert used == counts
    total = sum(length * n for length, n in counts.items())
    # best fit leaves few gaps; large pieces bound the number from below as well
    large = sum(n for length, n in counts.items() if 2 * length > 100)
    assert sum(many for many, _ in groups) <= 1.1 * max(-(-total // 100), large) + 1
    ends = {}
    for length, first, until, *_ in places(groups):
        assert first == ends.get(length, 0)
        ends[length] = until
    assert ends == counts


@pytest.mark.parametrize("capacity", [16, 2048])
def test_pack_round_trip(spark, capacity):
    data = rows()
    found = pack(docs(spark, data), capacity=capacity).collect()
    crcs, sequences = [], {}
    for i, text, *_ in data:
        ids = WHOLE.encode(text or "", add_special_tokens=False).ids + [0]
        for number, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start : start + capacity]
            crcs.append((i, number, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted([(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found], key=repr) == sorted(crcs, key=repr)
    for r in found:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    assert len(sequences) <= -(-sum(c[3] for c in crcs) // capacity) + 1


def test_empty(spark):
    assert pack(empty(spark)).count() == 0
