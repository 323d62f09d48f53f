"""A small gated recurrent language model in numpy.

Tokens are numbers: words 0..K-1 sorted by class, then one number per shape of
the words outside the vocabulary.  The output softmax is factored: first the
class (the word classes, then one class per shape), then the word within its
class.  A shape's class has no words; who scores a text adds what its words
weigh within their shape.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np

HIDDEN, CLASSES = 32, 48
#: Lanes that run side by side, and steps between two updates or two outputs.
LANES, WINDOW = 512, 64
#: Updates of a pass over the text, and steps between two of them.
UPDATES, STEPS = 160, 24
#: Tokens whose classes are weighed at once, in training and in scoring, and the least probability whose logarithm is taken.
BLOCK, SCORED, LEAST = 2048, 1024, 1e-30
#: Weights that an update goes through at once: what it reads of them stays in the processor's cache.
UPDATED = 1 << 15
#: Rows that are summed at once, for the same reason.
SUMMED = 1024
#: Lanes below which a product rounds by which of its sides is turned; there it is taken one way, so that weights stay the same.
FEW = 512


def class_bounds(counts: np.ndarray, classes: int = CLASSES) -> np.ndarray:
    """First word of each class and the end; words by falling count, classes of even mass (of square roots of counts)."""
    if not len(counts):
        return np.zeros(1, np.int64)
    mass = np.cumsum(np.sqrt(counts.astype(float)))
    cuts = np.searchsorted(mass, mass[-1] * np.arange(1, classes) / classes)
    return np.unique(np.concatenate([[0], cuts, [len(counts)]]))


def _sigmoid_of_negative(x: np.ndarray) -> np.ndarray:
    """Sigmoid of -x, in place."""
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _softmax(logits: np.ndarray) -> np.ndarray:
    """Turn logits into exponentials over their row's largest, in place; returns log of each row's sum, the largest left out.

    Rows are columns here, (choices, places): sums over choices run along memory.
    """
    logits -= logits.max(axis=0)
    return np.exp(logits, out=logits).sum(axis=0)


def _room(rooms: dict[str, np.ndarray], kind: np.dtype, name: str, *shape: int) -> np.ndarray:
    """Memory of that name and shape, as it was left: windows use the same again, as fresh pages cost a sixth of the time."""
    size = math.prod(shape)
    if name not in rooms or rooms[name].size < size or rooms[name].dtype != kind:
        rooms[name] = np.empty(size, kind)
    return rooms[name][:size].reshape(shape)


def _with_one(states: np.ndarray) -> np.ndarray:
    """States with a last column of ones, which meets the bias."""
    out = np.ones((len(states), states.shape[1] + 1), states.dtype)
    out[:, :-1] = states
    return out


def _sum_rows(rows: np.ndarray, order: np.ndarray, keys: np.ndarray, out: np.ndarray, spare: np.ndarray) -> None:
    """Sums of the rows of each key into the key's row of ``out``; ``order`` sorts the rows, ``keys`` are sorted.

    Keys that occur equally often are summed together, as many as ``spare`` has room for; one that has more rows is
    summed in pieces.
    """
    starts = np.flatnonzero(np.diff(keys, prepend=-1))
    times = np.diff(starts, append=len(keys))
    by_times, room = np.argsort(times, kind="stable"), len(spare)
    ends = np.flatnonzero(np.diff(times[by_times], append=0))
    for first, end in zip([0, *(ends[:-1] + 1).tolist()], (ends + 1).tolist(), strict=True):
        n = int(times[by_times[first]])
        for at in range(first, end, max(1, room // n)):
            here = starts[by_times[at : min(end, at + max(1, room // n))]]
            if n <= room:
                places = order[here[:, None] + np.arange(n)].ravel()
                block = rows.take(places, axis=0, out=spare[: len(places)], mode="clip").reshape(len(here), n, -1)
                out[keys[here]] = block.sum(axis=1) if n > 1 else block[:, 0]
                continue
            # the sum so far is the first row of the next piece
            spare[0] = 0
            for start in range(int(here[0]), int(here[0]) + n, room - 1):
                places = order[start : min(start + room - 1, int(here[0]) + n)]
                rows.take(places, axis=0, out=spare[1 : len(places) + 1], mode="clip")
                spare[0] = spare[: len(places) + 1].sum(axis=0)
            out[keys[here]] = spare[0]


@dataclass
class Model:
    bounds: np.ndarray  # first word of each word class, and K
    shapes: int
    inputs: np.ndarray  # (K + shapes, 3h): update, reset, candidate
    recurrent: np.ndarray  # (h, 3h)
    class_out: np.ndarray  # (h + 1, classes + shapes): the last row is the bias
    word_out: np.ndarray  # (K, h + 1)

    @classmethod
    def start(cls, counts: np.ndarray, shape_counts: np.ndarray, hidden: int = HIDDEN, classes: int = CLASSES, seed: int = 11) -> Model:
        """Small random weights; biases are the log shares of classes and words, so training starts at the unigram model."""
        draw = np.random.default_rng(seed)
        bounds, size = class_bounds(counts, classes), len(counts)
        in_class = np.add.reduceat(counts, bounds[:-1]) if size else np.zeros(0)
        class_out = np.zeros((hidden + 1, len(in_class) + len(shape_counts)), np.float32)
        class_out[-1] = np.log(np.concatenate([in_class, shape_counts]) + 1.0)
        class_out[-1] -= class_out[-1].max()
        word_out = np.zeros((size, hidden + 1), np.float32)
        word_out[:, -1] = np.log(counts + 1.0) - np.repeat(np.log(in_class + 1.0), np.diff(bounds)) if size else 0
        inputs = draw.normal(0, 0.1, (size + len(shape_counts), 3 * hidden)).astype(np.float32)
        inputs[:, :hidden] += 1.0  # keep most of the state at first
        recurrent = draw.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden)).astype(np.float32)
        return cls(bounds, len(shape_counts), inputs, recurrent, class_out, word_out)

    @property
    def words(self) -> int:
        return int(self.bounds[-1])

    def classes_of(self, tokens: np.ndarray) -> np.ndarray:
        tokens = tokens.astype(np.int64)
        found = np.searchsorted(self.bounds, tokens, side="right") - 1
        rare = tokens >= self.words
        found[rare] = len(self.bounds) - 1 + tokens[rare] - self.words
        return found

    def step(self, state: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """The next state of each lane (hidden, lanes)."""
        state = np.array(state.T, order="C")
        given, spare = np.empty((2, 3, *state.shape), state.dtype)
        self.step_from(state, self.looked_up(self.places(tokens), given), self.by_part(), spare[:2], spare[2])
        return state.T

    def by_part(self) -> np.ndarray:
        """Recurrent weights of update, reset and candidate (3, h, h), each one stretch of memory; the gates' negated."""
        h = len(self.recurrent)
        parts = np.array(self.recurrent.reshape(h, 3, h).transpose(1, 0, 2), order="C")
        np.negative(parts[:2], out=parts[:2])
        return parts

    @staticmethod
    def places(tokens: np.ndarray) -> np.ndarray:
        """Where the tokens' update, reset and candidate lie among the inputs (..., 3, lanes), for tokens (..., lanes)."""
        return 3 * tokens.astype(np.int64)[..., None, :] + np.arange(3)[:, None]

    def looked_up(self, places: np.ndarray, out: np.ndarray) -> np.ndarray:
        """Inputs at :meth:`places` (3, lanes), each part one stretch of memory: (3, lanes, h)."""
        return self.inputs.reshape(-1, out.shape[-1]).take(places, axis=0, out=out, mode="clip")

    @staticmethod
    def step_from(state: np.ndarray, given: np.ndarray, recurrent: np.ndarray, kept: np.ndarray, held: np.ndarray) -> None:
        """The next state in place; what was given (3, lanes, h) becomes both gates and the candidate.

        Lanes are rows, so lookups and products need no turning.  ``held``: what the candidate could keep; ``kept``
        (2, lanes, h) is spare.
        """
        # one product each: numpy leaves products of stacks to slower code
        for part, out in zip(recurrent, (*kept, held), strict=True):
            np.matmul(state, part, out=out)
        gates, candidate = given[:2], given[2]
        z, r = _sigmoid_of_negative(np.subtract(kept, gates, out=gates))
        candidate += np.multiply(r, held, out=kept[0])
        candidate *= -2
        _sigmoid_of_negative(candidate)  # tanh x = 2 sigmoid 2x - 1
        candidate *= 2
        candidate -= 1
        state -= candidate
        state *= z
        state += candidate

    def _parts(self, tokens: np.ndarray):
        """Of sorted tokens, the stretch of each class with a choice: (first word, end, stretch)."""
        edges = np.searchsorted(tokens, self.bounds)
        for k in np.flatnonzero((np.diff(edges) > 0) & (np.diff(self.bounds) > 1)):
            yield int(self.bounds[k]), int(self.bounds[k + 1]), slice(int(edges[k]), int(edges[k + 1]))

    def _sorted(self, tokens: np.ndarray) -> np.ndarray:
        """Order of the tokens by number; 16 bits, where they suffice, sort by radix."""
        small = self.words + self.shapes <= 1 << 16
        return np.argsort(tokens.astype(np.uint16) if small else tokens, kind="stable")

    def log_shares(self, states: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """Natural log of each token's probability; of a shape, if the token is one."""
        return self._log_shares(_with_one(states), tokens, {})

    def _log_shares(self, states: np.ndarray, tokens: np.ndarray, rooms: dict[str, np.ndarray]) -> np.ndarray:
        """:meth:`log_shares` of states that have their column of ones; ``rooms``: memory to use again."""
        order = self._sorted(tokens)
        tokens, states = tokens[order], states.take(order, axis=0, out=_room(rooms, states.dtype, "sorted", *states.shape), mode="clip")
        of, found = self.classes_of(tokens), np.empty(len(tokens), states.dtype)
        for start in range(0, len(tokens), SCORED):
            here = slice(start, start + SCORED)
            part = states[here]
            shares = np.matmul(self.class_out.T, part.T, out=_room(rooms, states.dtype, "shares", self.class_out.shape[1], len(part)))
            total = _softmax(shares)
            found[here] = shares[of[here], np.arange(len(total))] / total
        np.log(np.maximum(found, LEAST, out=found), out=found)
        for first, end, here in self._parts(tokens):
            part = states[here]
            shares = np.matmul(self.word_out[first:end], part.T, out=_room(rooms, states.dtype, "shares", end - first, len(part)))
            total = _softmax(shares)
            found[here] += np.log(np.maximum(shares[tokens[here] - first, np.arange(len(total))] / total, LEAST))
        out = np.empty_like(found)
        out[order] = found
        return out

    def score(self, texts: list[np.ndarray], lanes: int = LANES, window: int = WINDOW) -> np.ndarray:
        """Natural log-likelihood of each whole text; none is empty.

        Texts run in lanes, one after the other; a lane's state is carried from
        window to window and cleared where a text begins.
        """
        totals = np.zeros(len(texts))
        if not texts:
            return totals
        queues: list[list[int]] = [[] for _ in range(min(lanes, len(texts)))]
        load = [(0, n) for n in range(len(queues))]
        sizes = [len(t) for t in texts]
        for i in sorted(range(len(texts)), key=lambda i: -sizes[i]):
            size, n = heapq.heappop(load)
            queues[n].append(i)
            heapq.heappush(load, (size + sizes[i], n))
        queues.sort(key=lambda q: -sum(sizes[i] for i in q))
        lengths = np.array([sum(sizes[i] for i in q) for q in queues])
        # all lanes end to end: a lane's place t is at its base + t
        laid = [i for q in queues for i in q]
        stream = np.concatenate([texts[i] for i in laid]).astype(np.int32)
        owner = np.repeat(laid, [sizes[i] for i in laid]).astype(np.int32)
        begins = np.zeros(len(stream), bool)
        begins[np.cumsum([0, *[sizes[i] for i in laid[:-1]]])] = True
        base = np.cumsum([0, *lengths[:-1]])
        h, rooms = self.recurrent.shape[0], {}
        recurrent, kind = self.by_part(), self.inputs.dtype
        state = np.zeros((len(queues), h), kind)
        # what a window holds, with the column of ones that meets the bias
        states = np.ones((window * len(queues), h + 1), kind)
        start, longest, given = 0, int(lengths[0]), None
        while start < longest:
            # few lanes are left where texts are very long: their windows are longer, as many tokens are weighed at once
            ahead = window * len(queues) // int(np.searchsorted(-lengths, -start, side="left"))
            steps = np.arange(start, min(start + ahead, longest))
            lives = np.searchsorted(-lengths, -steps, side="left").tolist()
            at = np.concatenate([base[:live] + t for t, live in zip(steps.tolist(), lives, strict=True)])
            tokens, fresh = stream[at], np.flatnonzero(begins[at])
            places, ends = self.places(tokens), np.cumsum(lives)
            cuts = np.searchsorted(fresh, [0, *ends]).tolist()
            for k, (live, filled) in enumerate(zip(lives, (ends - lives).tolist(), strict=True)):
                if live != len(state) or given is None:
                    state = state[:live]
                    given, kept, held = [_room(rooms, kind, name, *n, live, h) for name, n in (("given", (3,)), ("kept", (2,)), ("held", ()))]
                if cuts[k] < cuts[k + 1]:
                    state[fresh[cuts[k] : cuts[k + 1]] - filled] = 0
                states[filled : filled + live, :h] = state
                self.step_from(state, self.looked_up(places[:, filled : filled + live], given), recurrent, kept, held)
            shares = self._log_shares(states[: len(at)], tokens, rooms)
            totals += np.bincount(owner[at], shares, len(texts))
            start += ahead
        return totals


class Trainer:
    """Truncated backpropagation through time with Adam."""

    NAMES = ("inputs", "recurrent", "class_out", "word_out")

    def __init__(self, model: Model, rate: float = 0.01):
        self.model, self.rate, self.turn = model, rate, 0
        self.first = {n: np.zeros_like(getattr(model, n)) for n in self.NAMES}
        self.second = {n: np.zeros_like(getattr(model, n)) for n in self.NAMES}
        self.rooms: dict[str, np.ndarray] = {}

    def room(self, name: str, *shape: int) -> np.ndarray:
        return _room(self.rooms, self.model.inputs.dtype, name, *shape)

    def window(self, state: np.ndarray, tokens: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, float]:
        """One update from tokens (lanes, steps); state is carried in and out, gradients end at the window's start."""
        m = self.model
        lanes, steps = tokens.shape
        h = state.shape[1]
        # step by step, so that a step's lanes are one stretch of memory
        tokens, fresh = np.ascontiguousarray(tokens.T), np.ascontiguousarray(fresh.T)
        truth, n, places, recurrent = tokens.ravel(), tokens.size, m.places(tokens), m.by_part()
        cleared = [np.flatnonzero(f) for f in fresh]
        before = self.room("before", steps, lanes, h + 1)
        before[:, :, h] = 1
        # a step's gates and candidate lie where it looks its inputs up, and its gradients where those were
        gates, held = self.room("gates", steps, 3, lanes, h), self.room("held", steps, lanes, h)
        kept, state = self.room("kept", 2, lanes, h), state.copy()
        for t in range(steps):
            if len(cleared[t]):
                state[cleared[t]] = 0
            before[t, :, :h] = state
            m.step_from(state, m.looked_up(places[t], gates[t]), recurrent, kept, held[t])
        grads = {name: self.room(f"grads of {name}", *getattr(m, name).shape) for name in self.NAMES}
        for grad in grads.values():
            grad.fill(0)
        order = m._sorted(truth)
        found, flat = truth[order], before.reshape(n, h + 1).take(order, axis=0, out=self.room("flat", n, h + 1), mode="clip")
        back, loss, of = self.room("back", n, h), 0.0, m.classes_of(found)
        for start in range(0, n, BLOCK):
            here = slice(start, min(start + BLOCK, n))
            shares = np.matmul(m.class_out.T, flat[here].T, out=self.room("shares", m.class_out.shape[1], here.stop - start))
            shares /= _softmax(shares)
            own = (of[here], np.arange(shares.shape[1]))
            loss -= float(np.log(shares[own] + LEAST).sum())
            shares[own] -= 1
            grads["class_out"] += (shares @ flat[here]).T
            np.matmul(shares.T, m.class_out[:-1].T, out=back[here])
        for first, end, here in m._parts(found):
            weights, part = m.word_out[first:end], flat[here]
            shares = np.matmul(weights, part.T, out=self.room("shares", end - first, len(part)))
            shares /= _softmax(shares)
            own = (found[here] - first, np.arange(len(part)))
            loss -= float(np.log(shares[own] + LEAST).sum())
            shares[own] -= 1
            np.matmul(shares, part, out=grads["word_out"][first:end])
            back[here] += shares.T @ weights[:, :-1]
        back_to = np.empty(n, np.int64)
        back_to[order] = np.arange(n)
        ahead, d_candidate, spare = self.room("ahead", lanes, h), self.room("d candidate", lanes, h), self.room("spare", lanes, h)
        through = self.room("through", lanes, 3 * h)
        ahead.fill(0)
        for t in range(steps - 1, -1, -1):
            old, (z, r, candidate) = before[t, :, :h], gates[t]
            np.subtract(1, z, out=d_candidate)
            d_update = np.multiply(z, d_candidate, out=kept[0])
            d_candidate *= ahead
            np.subtract(old, candidate, out=spare)
            spare *= ahead
            np.multiply(d_update, spare, out=through[:, :h])
            np.multiply(candidate, candidate, out=spare)
            d_candidate *= np.subtract(1, spare, out=spare)
            d_held = np.multiply(d_candidate, r, out=kept[0])
            np.multiply(held[t], np.subtract(1, r, out=spare), out=spare)
            np.multiply(d_held, spare, out=through[:, h : 2 * h])
            through[:, 2 * h :] = d_held
            grads["recurrent"] += old.T @ through
            ahead *= z
            if lanes < FEW:
                ahead += np.matmul(m.recurrent, np.ascontiguousarray(through.T)).T
            else:
                ahead += np.matmul(through, m.recurrent.T, out=spare)
            ahead += back.take(back_to[t * lanes : (t + 1) * lanes], axis=0, out=spare, mode="clip")
            if len(cleared[t]):
                ahead[cleared[t]] = 0
            # what passes through the recurrent weights meets the reset gate, what is given does not
            through[:, 2 * h :] = d_candidate
            gates[t] = through.reshape(3, lanes, h)
        _sum_rows(gates.reshape(n, 3 * h), order, found, grads["inputs"], self.room("sorted", SUMMED, 3 * h))
        self._update(grads, n)
        return state, loss

    def _update(self, grads: dict[str, np.ndarray], n: int) -> None:
        self.turn += 1
        squares = {name: np.multiply(g, g, out=self.room(f"squares of {name}", *g.shape)) for name, g in grads.items()}
        size = np.sqrt(sum(float(g.sum()) for g in squares.values())) / n
        scale = np.float32(min(1.0, 1.0 / max(size, 1e-12)) / n)
        fix = np.float32(self.rate * np.sqrt(1 - 0.99**self.turn) / (1 - 0.9**self.turn))
        for name, whole in grads.items():
            rows = max(1, UPDATED // whole.shape[1])
            for start in range(0, len(whole), rows):
                here = slice(start, start + rows)
                grad, a, b, spare = whole[here], self.first[name][here], self.second[name][here], squares[name][here]
                grad *= scale
                np.subtract(grad, a, out=spare)
                spare *= np.float32(0.1)
                a += spare
                np.multiply(grad, grad, out=spare)
                spare -= b
                spare *= np.float32(0.01)
                b += spare
                np.sqrt(b, out=spare)
                spare += np.float32(1e-8)
                getattr(self.model, name)[here] -= np.divide(np.multiply(fix, a, out=grad), spare, out=spare)


def train(model: Model, texts: list[np.ndarray], passes: int = 1, updates: int = UPDATES, window: int = STEPS, span: tuple[float, float] = (0.0, 1.0)) -> list[float]:
    """Train in place on every token; returns the mean loss of each pass.

    Texts are laid end to end and cut into lanes of one length, as many as make
    about ``updates`` updates of ``window`` steps a pass; what is left, under one
    token a lane, follows in a lane of its own.  ``span``: from and to which share
    of the whole training this is, for the falling rate.
    """
    texts = [t for t in texts if len(t)]
    if not texts or not model.words:
        return []
    lanes = min(max(1, sum(map(len, texts)) // (updates * window)), len(texts))
    order = np.random.default_rng(5).permutation(len(texts))
    trainer, losses = Trainer(model), []
    for number in range(passes):
        turn = [texts[i] for i in np.roll(order, number * 7)]
        stream = np.concatenate(turn).astype(np.int64)
        begins = np.zeros(len(stream), bool)
        begins[np.cumsum([0, *map(len, turn[:-1])])] = True
        length, total = len(stream) // lanes, 0.0
        whole = lanes * length
        for part, rows in ((slice(0, whole), lanes), (slice(whole, None), 1)):
            tokens, fresh = stream[part].reshape(rows, -1), begins[part].reshape(rows, -1)
            state = np.zeros((rows, model.recurrent.shape[0]), np.float32)
            for start in range(0, tokens.shape[1], window):
                done = (number + min(1.0, (part.start + rows * start) / len(stream))) / passes
                trainer.rate = 0.01 * (1 - 0.95 * (span[0] + (span[1] - span[0]) * done))
                state, loss = trainer.window(state, tokens[:, start : start + window], fresh[:, start : start + window])
                total += loss
        losses.append(total / len(stream))
    return losses


def flat(model: Model) -> np.ndarray:
    """All weights one after the other."""
    return np.concatenate([getattr(model, n).ravel() for n in Trainer.NAMES])


def fill(model: Model, weights: np.ndarray) -> None:
    """Set all weights from :func:`flat`."""
    at = 0
    for n in Trainer.NAMES:
        part = getattr(model, n)
        part[...] = weights[at : at + part.size].reshape(part.shape)
        at += part.size
