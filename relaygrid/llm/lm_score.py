"""Language-model scores of whole documents.

Word counts cover every training document.  The most frequent words are the
vocabulary of a gated recurrent model (:mod:`relaygrid.llm.gru`); every other
word belongs to a class given by its shape (last character, non-ASCII or not),
within which it weighs (count + 1), unseen words of a shape sharing one such
place.  So every text has a probability, whatever its words.

The recurrent weights learn from every training token, in rounds: trainers, more
of them for more text, start from the same weights, each learns from its share,
and the mean of their weights begins the next round.

Counts are never gathered whole.  A table of the most frequent words, of fixed
size, travels to the tasks; the words beyond it leave a document as (word, how
often) and meet their counts in a join.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relaygrid.llm import gru
from relaygrid.llm.common import remainder
from relaygrid.session import settle

#: Words that the model knows, and words whose counts travel to the tasks.
VOCABULARY, FREQUENT = 4096, 200_000
#: Rounds of training, tokens of a trainer in a round, tokens of a stretch of text, and weights of a slice on the way to their mean.
ROUNDS, TRAINER_TOKENS, STRETCH, SLICE = 4, 3_000_000, 512, 16_384
#: Words with their counts that a counting task holds, bytes of text split at once, and tokens that a scoring task lays out at once.
HELD, SPLIT, AT_ONCE = 500_000, 1 << 23, 6_000_000
END = b""
SHAPES = 12
_KIND = {**{c: 1 for c in b"."}, **{c: 2 for c in b",;:"}, **{c: 3 for c in b"!?"}, **{c: 4 for c in b"0123456789"}}
_KIND |= {c: 5 for c in range(0x21, 0x7F) if c not in _KIND and not chr(c).isalpha()}


_KINDS = np.array([_KIND.get(c, 0) for c in range(256)])


def _slices(batches: Iterable[pa.RecordBatch], texts: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about SPLIT bytes of text, as words take several times their text; ``texts``: place of the texts."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(texts)), 0).to_numpy().astype(np.int64)
        starts = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // SPLIT, prepend=-1))
        for start, end in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows], strict=True) if len(starts) else ():
            yield batch.slice(start, end - start)


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Words of each text, A-Z lower-cased: how many, and all of them one after the other; a null text has none.

    Arrow's ASCII functions know exactly the six blanks and the letters A-Z of
    the contracts, and no byte of a longer sequence is either.
    """
    plain = pc.fill_null(texts.cast(pa.large_binary()), pa.scalar(b"", pa.large_binary()))
    if not len(plain):
        return np.zeros(0, np.int64), plain
    # ascii_lower reads a slice wrongly unless its bytes begin where their buffer does
    ends, data = np.frombuffer(plain.buffers()[1], np.int64)[plain.offset : plain.offset + len(plain) + 1], plain.buffers()[2] or pa.py_buffer(b"")
    first, last = int(ends[0]), int(ends[-1])
    plain = pa.Array.from_buffers(pa.large_string(), len(plain), [None, pa.py_buffer(ends - first), data.slice(first, last - first)])
    pieces = pc.ascii_split_whitespace(pc.ascii_lower(plain))
    sizes, words = np.diff(pieces.offsets.to_numpy()).astype(np.int64), pieces.flatten().view(pa.large_binary())
    # blanks at either end leave an empty piece
    real = pc.greater(pc.binary_length(words), 0)
    if pc.all(real).as_py():
        return sizes, words
    of = np.repeat(np.arange(len(sizes)), sizes)[real.to_numpy(zero_copy_only=False)]
    return np.bincount(of, minlength=len(sizes)), words.filter(real)


def shapes(words: pa.Array) -> np.ndarray:
    """Classes of words outside the vocabulary: by the last byte, and whether the word is ASCII; none is empty."""
    if not len(words):
        return np.zeros(0, np.int64)
    words = words.cast(pa.large_binary())
    ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset + 1 : words.offset + len(words) + 1]
    last = np.frombuffer(words.buffers()[2], np.uint8)[ends - 1]
    return 2 * _KINDS[last] + ~pc.string_is_ascii(words.view(pa.large_string())).to_numpy(zero_copy_only=False)


def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """word, shape (null for the end token), n; the end token is the empty word, once per document."""
    kind = T.StructType([T.StructField("word", T.BinaryType()), T.StructField("shape", T.IntegerType()), T.StructField("n", T.LongType())])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[pa.StructArray] = []
        rows = ends = 0

        def out() -> Iterator[pa.RecordBatch]:
            words, n = pa.concat_arrays([x.field("values") for x in seen]), np.concatenate([x.field("counts").to_numpy() for x in seen])
            if len(seen) > 1:
                # a third of the time that Arrow takes to group by bytes
                found = pc.dictionary_encode(words)
                sums = np.zeros(len(found.dictionary), np.int64)
                np.add.at(sums, found.indices.to_numpy(), n)
                words, n = found.dictionary, sums
            yield pa.RecordBatch.from_arrays([words.cast(pa.binary()), pa.array(shapes(words), pa.int32()), pa.array(n, pa.int64())], ["word", "shape", "n"])

        for batch in _slices(batches, 0):
            times = pc.value_counts(words_of(batch.column(0))[1])
            seen.append(times)
            rows, ends = rows + len(times), ends + batch.num_rows
            if rows >= HELD:
                yield from out()
                seen, rows = [], 0
        if seen:
            yield from out()
        yield pa.RecordBatch.from_arrays([pa.array([END], pa.binary()), pa.array([None], pa.int32()), pa.array([ends], pa.int64())], ["word", "shape", "n"])

    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(count, kind).where("n > 0")
    # tasks have counted already: one sum where the words meet, none before
    return counted.repartition("word").groupBy("word").agg(F.min("shape").alias("shape"), F.sum("n").alias("n"))


def _least_count(counts: DataFrame, most: int) -> int:
    """Smallest count from which on there are at most ``most`` words.

    Words are counted by their count, large counts in steps of a percent: a few
    thousand rows for any table, and no word is sorted.
    """
    step = F.when(F.col("n") <= 1024, F.col("n")).otherwise(1024 + F.floor(F.log2(F.col("n") / 1024) * 64)).cast("long")
    steps = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("low"), F.max("n").alias("high")).collect()
    least, words = max((r["high"] for r in steps), default=0) + 1, 0
    for r in sorted(steps, key=lambda r: -r["step"]):
        words += r["words"]
        if words > most:
            break
        least = r["low"]
    return least


class Frequent:
    """The most frequent words, the vocabulary first, and what each counts for."""

    def __init__(self, table: pa.Table, totals: dict[int | None, tuple[int, int]], vocabulary: int):
        rows = zip(table["word"].to_pylist(), table["n"].to_pylist(), table["shape"].to_pylist(), strict=True)
        rows = sorted(rows, key=lambda r: (-r[1], r[0]))
        self.tokens, self.distinct = sum(n for n, _ in totals.values()), sum(v for _, v in totals.values())
        ends = totals.get(None, (0, 0))[0]
        words = [r for r in rows if r[0] != END]
        known = sorted([*words[: vocabulary - 1], (END, ends, None)], key=lambda r: (-r[1], r[0]))
        rest = words[vocabulary - 1 :]
        self.words = [r[0] for r in known + rest]
        self.counts = np.array([r[1] for r in known], float)
        self.sought, self.end = pa.array(self.words, pa.large_binary()), self.words.index(END)
        self.size, self.k = len(self.words), len(known)
        # what is left in each shape
        self.shape_tokens, self.shape_words = np.zeros(SHAPES), np.zeros(SHAPES)
        for s, (n, v) in totals.items():
            if s is not None:
                self.shape_tokens[s], self.shape_words[s] = n, v
        for word, n, s in known:
            if word != END:
                self.shape_tokens[s] -= n
                self.shape_words[s] -= 1
        log = [math.log10(r[1] + 1) for r in known + rest]
        self.base = np.array(log + [0.0] * SHAPES)
        within = -np.log10(self.shape_tokens + self.shape_words + 1)
        self.token = np.array([*range(self.k), *[self.k + r[2] for r in rest], *range(self.k, self.k + SHAPES)], np.uint16 if self.k + SHAPES <= 1 << 16 else np.int32)
        # known words weigh in the model alone; others by (count + 1) within their shape
        self.inner = np.array([0.0] * self.k + [math.log10(r[1] + 1) + within[r[2]] for r in rest] + list(within))

    def numbers(self, words: pa.Array) -> np.ndarray:
        """Number of each word; beyond the frequent ones, ``size`` and the word's shape."""
        found = pc.index_in(words, value_set=self.sought)
        ids, beyond = pc.fill_null(found, -1).to_numpy().astype(np.int64), found.is_null()
        if found.null_count:
            ids[ids < 0] = self.size + shapes(words.filter(beyond))
        return ids


def _numbered(docs: DataFrame, id_col: str, text_col: str, frequent: Frequent) -> DataFrame:
    """Every text split and looked up once, and written: key, id, what its words count for, rare words, tokens.

    ``base`` and ``inner`` leave out the rare words, whose counts are still to be looked up.
    """
    rare = T.ArrayType(T.StructType([T.StructField("word", T.BinaryType()), T.StructField("times", T.LongType())]))
    kind = T.StructType([
        T.StructField("key", T.LongType()), T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()),
        T.StructField("n_known", T.LongType()), T.StructField("base", T.DoubleType()), T.StructField("inner", T.DoubleType()),
        T.StructField("rare", rare), T.StructField("tokens", T.BinaryType()),
    ])
    each = math.log10(frequent.tokens + frequent.distinct + 1)

    def number(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, 2):
            sizes, words = words_of(batch.column(2))
            found = frequent.numbers(words)
            # a text's words and then its end
            ends = np.cumsum(sizes + 1)
            ids, inside = np.full(len(words) + len(sizes), frequent.end, np.int64), np.ones(len(words) + len(sizes), bool)
            inside[ends - 1] = False
            ids[inside] = found
            base, inner, tokens = frequent.base[ids], frequent.inner[ids], frequent.token[ids]
            spans = [slice(a, b) for a, b in zip((ends - sizes - 1).tolist(), ends.tolist(), strict=True)]
            beyond = found >= frequent.size
            rares = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[beyond], minlength=len(sizes))
            names, at = words.filter(pa.array(beyond)).to_pylist(), 0
            words_out: list[bytes] = []
            times_out: list[int] = []
            offsets = [0]
            for n in rares.tolist():
                if n:
                    times = Counter(names[at : at + n])
                    words_out.extend(times.keys()), times_out.extend(times.values())
                    at += n
                offsets.append(len(words_out))
            pairs = pa.StructArray.from_arrays([pa.array(words_out, pa.binary()), pa.array(times_out, pa.int64())], ["word", "times"])
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(sizes + 1, pa.int64()), pa.array(sizes + 1 - rares, pa.int64()),
                pa.array([float(base[s].sum()) - (s.stop - s.start) * each for s in spans], pa.float64()),
                pa.array([float(inner[s].sum()) for s in spans], pa.float64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs),
                pa.array([tokens[s].tobytes() for s in spans], pa.binary()),
            ], kind.fieldNames())

    placed = docs.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return settle(placed.mapInArrow(number, kind), "lm-numbered")


def _stretches(numbered: DataFrame, frequent: Frequent) -> DataFrame:
    """round, tokens: all of the text in stretches, written once."""
    kind = T.StructType([T.StructField("round", T.IntegerType()), T.StructField("tokens", T.BinaryType())])
    size = STRETCH * frequent.token.itemsize

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rounds, found = [], []
            for key, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for start in range(0, len(tokens), size):
                    rounds.append(xxhash.xxh3_64_intdigest(b"%d %d" % (key, start)) % ROUNDS)
                    found.append(tokens[start : start + size])
            yield pa.RecordBatch.from_arrays([pa.array(rounds, pa.int32()), pa.array(found, pa.binary())], ["round", "tokens"])

    return settle(numbered.select("key", "tokens").mapInArrow(cut, kind), "lm-stretches")


def _round(stretches: DataFrame, model: gru.Model, kept: np.dtype, trainers: int, span: tuple[float, float]) -> int:
    """One round of training, the weights in place; returns how many tokens taught.

    Only weights travel: a trainer's slices go to where their slice is summed, and the sums, of fixed size, to the driver.
    """
    kind = T.StructType([T.StructField("slice", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("weights", T.BinaryType())])

    def learn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = [np.frombuffer(t, kept) for batch in batches for t in batch.column(0).to_pylist()]
        if texts:
            gru.train(model, texts, span=span)
            weights, n = gru.flat(model), sum(map(len, texts))
            parts = [weights[at : at + SLICE].tobytes() for at in range(0, len(weights), SLICE)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(parts)), pa.int32()), pa.array([n] * len(parts), pa.int64()), pa.array(parts, pa.binary())], ["slice", "n", "weights"]
            )

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        tokens: Counter[int] = Counter()
        for batch in batches:
            for at, n, weights in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                sums[at] = sums.get(at, 0.0) + np.frombuffer(weights, np.float32).astype(np.float64) * n
                tokens[at] += n
        yield pa.RecordBatch.from_arrays(
            [pa.array(sums.keys(), pa.int32()), pa.array([tokens[k] for k in sums], pa.int64()), pa.array([v.tobytes() for v in sums.values()], pa.binary())],
            ["slice", "n", "weights"],
        )

    learnt = stretches.select("tokens").repartition(trainers).mapInArrow(learn, kind)
    # one row a slice
    rows = sorted(learnt.repartition("slice").mapInArrow(add, kind).collect(), key=lambda r: r["slice"])
    if not rows:
        return 0
    gru.fill(model, np.concatenate([np.frombuffer(r["weights"], np.float64) / r["n"] for r in rows]))
    return rows[0]["n"]


def _train(numbered: DataFrame, frequent: Frequent) -> tuple[gru.Model, int]:
    """The model, and how many tokens taught it: all of the given texts."""
    model = gru.Model.start(frequent.counts, frequent.shape_tokens)
    stretches = _stretches(numbered, frequent)
    trainers = -(-frequent.tokens // (ROUNDS * TRAINER_TOKENS))
    taught = sum(
        _round(stretches.where(F.col("round") == k), model, frequent.token.dtype, trainers, (k / ROUNDS, (k + 1) / ROUNDS)) for k in range(ROUNDS)
    )
    return model, taught


def _scored(numbered: DataFrame, model: gru.Model, kept: np.dtype) -> DataFrame:
    """key, likely: log10 of what the model gives each whole text."""

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            likely, texts, held = [np.zeros(0)], [], 0
            for tokens in batch.column(1).to_pylist():
                texts.append(np.frombuffer(tokens, kept))
                held += len(texts[-1])
                if held >= AT_ONCE:
                    likely.append(model.score(texts))
                    texts, held = [], 0
            likely.append(model.score(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(likely) / math.log(10), pa.float64())], ["key", "likely"])

    return numbered.select("key", "tokens").mapInArrow(score, "key long, likely double")


def lm_score(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    vocabulary: int = VOCABULARY, frequent: int = FREQUENT,
) -> DataFrame:
    """Log10 probability of every whole text under the model, and under the plain unigram model.

    One row per input row: ``id_col``, held_out, n_tokens, n_known, train_tokens,
    base_score, score.  Tokens are words (A-Z lower-cased) and then one end.

    * Rows whose crc32(id) mod 7 is 2 (``held_out``) teach nothing.
    * Null and empty texts are the end token alone.
    * If no row teaches, every token has base probability 1 by its formula, and
      ``score`` is ``base_score``.
    * Repeated rows are scored each; an empty table gives an empty result; other
      columns take no part.
    """
    held = remainder(F.col(id_col), 7) == 2
    teach = docs.where(~held)
    counts = settle(count_words(teach, text_col), "lm-counts")
    totals = {r["shape"]: (r["n"], r["v"]) for r in counts.groupBy("shape").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    least = _least_count(counts, frequent)
    # at most ``frequent`` rows
    top = counts.where(F.col("n") >= least).select("word", "n", "shape").toArrow()
    known = Frequent(top, totals, vocabulary)
    if not known.tokens:
        n = F.lit(0).cast("long")
        size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"([^\x20\x09-\x0D]+)")), F.lit(0)).cast("long") + 1
        zero = F.lit(0.0)
        return docs.select(
            F.col(id_col).alias(id_col), held.alias("held_out"), size.alias("n_tokens"), n.alias("n_known"), n.alias("train_tokens"),
            zero.alias("base_score"), zero.alias("score"),
        )
    numbered = _numbered(docs, id_col, text_col, known)
    model, _ = _train(numbered.where(remainder(F.col("id"), 7) != 2), known)
    scored = settle(_scored(numbered, model, known.token.dtype), "lm-scored")
    rare = numbered.select("key", F.explode("rare").alias("w")).select("key", "w.word", "w.times")
    late = counts.where(F.col("n") < least).select("word", "n")
    found = rare.join(late, "word").groupBy("key").agg(
        F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("n") + F.lit(1.0))).alias("more")
    )
    more = F.coalesce("more", F.lit(0.0))
    return numbered.drop("rare", "tokens").join(scored, "key").join(found, "key", "left").select(
        F.col("id").alias(id_col), (remainder(F.col("id"), 7) == 2).alias("held_out"), "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(known.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"), (F.col("likely") + F.col("inner") + more).alias("score"),
    )
