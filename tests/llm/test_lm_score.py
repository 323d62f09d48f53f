import collections
import math
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from samples import docs, empty, rows

from relaygrid.llm import gru, lm_score
from relaygrid.llm.common import read


def tokens(text):
    return [*(text or "").encode().lower().split(), b""]


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


def check_counts(data, found):
    counts = collections.Counter(t for i, text in data if not held(i) for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    want = sorted([(i, held(i), len(tokens(t)), sum(counts[x] > 0 for x in tokens(t)), n) for i, t in data], key=repr)
    assert sorted([(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) for r in found], key=repr) == want
    base = sorted([sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in tokens(t)) for _, t in data])
    assert sorted(r["base_score"] for r in found) == pytest.approx(base)


@pytest.mark.parametrize("frequent", [30, 200_000])
def test_odd_rows(spark, frequent):
    found = lm_score.lm_score(docs(spark), vocabulary=20, frequent=frequent).collect()
    check_counts([r[:2] for r in rows()], found)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in found)


def test_no_teacher_and_empty(spark):
    out = [i for i in range(100) if held(i)]
    found = lm_score.lm_score(docs(spark, [(i, "some text", "en", "a") for i in out])).collect()
    assert {(r["base_score"], r["score"], r["n_tokens"], r["n_known"], r["train_tokens"]) for r in found} == {(0.0, 0.0, 3, 0, 0)}
    assert lm_score.lm_score(empty(spark)).count() == 0


def test_model_beats_unigrams_on_held_out_texts(spark):
    frame = read(spark, "/root/testdata/sf0.01", "documents")
    found = lm_score.lm_score(frame, vocabulary=1000).collect()
    check_counts([(r["doc_id"], r["text"]) for r in frame.collect()], found)
    out = [r for r in found if r["held_out"]]
    assert sum(r["score"] for r in out) > 0.95 * sum(r["base_score"] for r in out)


def small(seed=0):
    counts = np.array([50, 30, 20, 9, 9, 4, 1], float)
    model = gru.Model.start(counts, np.array([5.0, 3.0]), hidden=5, classes=3, seed=seed)
    draw = np.random.default_rng(seed)
    for name in gru.Trainer.NAMES:
        part = getattr(model, name)
        part += draw.normal(0, 0.3, part.shape).astype(np.float32)
    return model


def test_probabilities_sum_to_one():
    model = small()
    states = np.random.default_rng(1).normal(size=(4, 5)).astype(np.float32)
    total = sum(np.exp(model.log_shares(states, np.full(4, token))) for token in range(9))
    assert np.allclose(total, 1, atol=1e-5)


def test_lanes_and_windows_do_not_matter():
    model, draw = small(), np.random.default_rng(2)
    texts = [draw.integers(0, 9, n) for n in (1, 40, 3, 17, 1, 100, 16)]
    alone = [model.score([t])[0] for t in texts]
    assert np.allclose(model.score(texts, lanes=3, window=4), alone, rtol=1e-4)
    # straight from the definition, one token after the other
    state, total = np.zeros((1, 5), np.float32), 0.0
    for token in texts[1]:
        total += float(model.log_shares(state, np.array([token]))[0])
        state = model.step(state.T, np.array([token])).T
    assert total == pytest.approx(alone[1], rel=1e-4)


def test_gradients_match_differences():
    model = small(3)
    draw = np.random.default_rng(4)
    tokens_, fresh = draw.integers(0, 9, (3, 6)), np.zeros((3, 6), bool)
    fresh[1, 3] = True
    state = draw.normal(0, 0.5, (3, 5)).astype(np.float32)
    for name in gru.Trainer.NAMES:
        setattr(model, name, getattr(model, name).astype(np.float64))
    caught = {}
    trainer = gru.Trainer(model)
    trainer._update = lambda grads, n: caught.update({k: g.copy() for k, g in grads.items()})
    trainer.window(state, tokens_, fresh)
    grads = dict(caught)
    for name in gru.Trainer.NAMES:
        part = getattr(model, name)
        for _ in range(6):
            at = tuple(draw.integers(0, n) for n in part.shape)
            kept = part[at]
            losses = []
            for shift in (1e-3, -1e-3):
                part[at] = kept + shift
                losses.append(trainer.window(state, tokens_, fresh)[1])
            part[at] = kept
            assert grads[name][at] == pytest.approx((losses[0] - losses[1]) / 2e-3, abs=2e-3)


def test_counts_beyond_the_table_are_joined(spark):
    """A hot rare word set: many documents share words that the travelling table does not hold."""
    data = [(i, " ".join(f"w{j}" for j in range(i % 40, i % 40 + 30)), "en", "a") for i in range(120)]
    found = lm_score.lm_score(docs(spark, data).repartition(5, F.col("doc_id")), vocabulary=5, frequent=10).collect()
    check_counts([r[:2] for r in data], found)


def test_every_training_token_teaches(spark, monkeypatch):
    """In several trainers a round, and none is left over at the end of a lane."""
    monkeypatch.setattr(lm_score, "TRAINER_TOKENS", 300)
    data = [(i, " ".join(f"w{j % 50}" for j in range(i, i + 1 + i * 37 % 900)), "en", "a") for i in range(40)]
    frame = docs(spark, data)
    counts = lm_score.count_words(frame).toArrow()
    totals = {}
    for s, n in zip(counts["shape"].to_pylist(), counts["n"].to_pylist(), strict=True):
        totals[s] = (totals.get(s, (0, 0))[0] + n, totals.get(s, (0, 0))[1] + 1)
    known = lm_score.Frequent(counts, totals, 30)
    model, taught = lm_score._train(lm_score._numbered(frame, "doc_id", "text", known), known)
    assert taught == known.tokens == sum(len(tokens(r[1])) for r in data)
    started = gru.Model.start(known.counts, known.shape_tokens)
    assert np.isfinite(gru.flat(model)).all() and not np.allclose(gru.flat(model), gru.flat(started))


def test_no_token_is_left_out_of_a_pass(monkeypatch):
    model, draw, seen = small(), np.random.default_rng(5), []
    monkeypatch.setattr(gru.Trainer, "window", lambda self, state, part, fresh: (seen.extend(part.ravel().tolist()), (state, 0.0))[1])
    texts = [draw.integers(0, 9, n) for n in (1, 40, 3, 17, 1, 100, 16)]
    gru.train(model, texts, updates=3)
    assert sorted(seen) == sorted(np.concatenate(texts).tolist())


def test_words_and_shapes_of_odd_texts():
    """Whole columns at once, as each text split and each word looked at alone."""
    draw = np.random.default_rng(6)
    letters = list(" \t\n\v\f\r\x1c\x85\u00a0\u2003aAbZ.,!1Éé中")
    texts = [None, "", "  ", " a", "A ", *["".join(draw.choice(letters, n)) for n in draw.integers(0, 30, 500)]]
    sizes, words = lm_score.words_of(pa.array(texts))
    plain = [tokens(t)[:-1] for t in texts]
    flat = [w for t in plain for w in t]
    assert sizes.tolist() == list(map(len, plain)) and words.to_pylist() == flat
    # slices, with and without nulls
    for column in (pa.array(texts), pa.array([t or "" for t in texts]), pa.array([None] * len(texts), pa.string())):
        for start, size in ((2, 90), (300, 100), (7, 0), (500, 5)):
            sizes_, words_ = lm_score.words_of(column.slice(start, size))
            cut = [tokens(t)[:-1] for t in column.slice(start, size).to_pylist()]
            assert sizes_.tolist() == list(map(len, cut)) and words_.to_pylist() == [w for t in cut for w in t]
    want = [2 * lm_score._KIND.get(w[-1], 0) + (not w.isascii()) for w in flat]
    assert lm_score.shapes(words).tolist() == want and lm_score.shapes(words[7:90]).tolist() == want[7:90]


def test_windows_train_in_the_same_memory():
    """A window of fewer lanes or steps, too, takes no fresh pages, and learns as in its own."""
    draw = np.random.default_rng(7)
    parts = [(draw.integers(0, 9, shape), np.zeros(shape, bool)) for shape in ((6, 5), (6, 5), (6, 2), (1, 4))]
    first, second = small(), small()
    reused, told = gru.Trainer(first), []
    for part, fresh in parts:
        reused.window(np.zeros((len(part), 5), np.float32), part, fresh)
        told.append({name: room.ctypes.data for name, room in reused.rooms.items()})
    assert told[0] and told[0] == told[1] == told[2] == told[3]
    alone = gru.Trainer(second)
    for part, fresh in parts:
        alone.rooms = {}
        alone.window(np.zeros((len(part), 5), np.float32), part, fresh)
    assert (gru.flat(first) == gru.flat(second)).all()


def test_texts_are_split_in_slices(monkeypatch):
    """Every row once and in its place, also of a text larger than a slice and of a batch without rows."""
    monkeypatch.setattr(lm_score, "SPLIT", 10)
    texts = [None, "abc", "d" * 35, "", "ef", "g" * 9, "hi", None]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])]
    batches.append(batches[0].slice(0, 0))
    found = [s.column(0).to_pylist() for s in lm_score._slices(batches, 0)]
    assert sum(found, []) == texts and len(found) > 2 and all(found)


@pytest.mark.parametrize("room", [2, 7, 50, 400])
def test_rows_are_summed_in_pieces(room):
    """Many keys of one frequency, one key of many rows, and the last bit as if all had room at once."""
    draw = np.random.default_rng(8)
    keys = draw.permutation([*range(3, 60), *np.repeat(np.arange(60, 90), 2), *[1] * 130, *[97] * 3])
    rows, order = draw.normal(size=(len(keys), 6)).astype(np.float32), np.argsort(keys, kind="stable")
    want, found = np.zeros((100, 6), np.float32), np.zeros((100, 6), np.float32)
    for key, row in zip(keys[order].tolist(), rows[order], strict=True):
        want[key] += row
    gru._sum_rows(rows, order, keys[order], found, np.empty((room, 6), np.float32))
    assert (found == want).all()


def test_a_step_works_in_place():
    """Nothing as large as the lanes is made anew, and lanes of any number get the same states."""
    model, tokens_ = small(), np.random.default_rng(9).integers(0, 9, 300)
    state, spare = np.full((300, 5), 0.25, np.float32), np.empty((6, 300, 5), np.float32)
    places, recurrent = model.places(tokens_), model.by_part()
    tracemalloc.start()
    model.step_from(state, model.looked_up(places, spare[:3]), recurrent, spare[3:5], spare[5])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < state.nbytes
    alone = [model.step(np.full((5, 1), 0.25, np.float32), tokens_[i : i + 1])[:, 0] for i in range(300)]
    assert np.allclose(state, alone, rtol=1e-6) and (state != 0.25).all()


def test_words_of_several_slices_are_summed(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "SPLIT", 40)
    data = [(i, " ".join(f"W{j % 7} \u00e9{j % 3}" for j in range(i % 9)), "en", "a") for i in range(60)]
    want = collections.Counter(t for _, text, *_ in data for t in tokens(text))
    rows_ = lm_score.count_words(docs(spark, data).coalesce(1)).collect()
    assert {bytes(r["word"]): r["n"] for r in rows_} == want and len(rows_) == len(want)
