"""Best-fit packing of documents into sequences of fixed capacity.

Only documents longer than the capacity are cut.  Two pieces of one length are
interchangeable, so the plan is made on the histogram of lengths, which never
has more rows than the capacity has tokens, however many documents there are.

* Large pieces, over a third of the capacity, stand at most two in a sequence:
  from the longest down, each takes the longest partner that fits.
* Smaller pieces, from the longest down, go where the gap is smallest (best
  fit); runs of equal pieces and of equal sequences are placed at once.

A piece then finds its place by its rank among the pieces of its length; the
ranks come from pre-aggregated counts, so no length, however common, meets in
one task.
"""

from __future__ import annotations

import heapq
import os
import zlib
from array import array
from collections.abc import Iterable, Iterator
from unicodedata import is_normalized

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relaygrid.llm.common import buckets_for, running, utf8
from relaygrid.session import settle

CAPACITY = 2048
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
END_ID = 0
#: Entries that one task keeps of what it has tokenised already.
CACHE = 500_000
#: ASCII signs that the vocabulary never joins to letters, the apostrophe apart.
_MARKS = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum() and c != 0x27)
_LOWER = {c: c + 32 for c in range(65, 91)}
#: The vocabulary writes a byte as the character of that number if it is visible, else as the next free one from 256 on.
_HIDDEN = [b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD)]
_VISIBLE = {b: 256 + n for n, b in enumerate(_HIDDEN)}


class ChunkTokenizer(dict):
    """Token ids of whole texts, chunk by chunk; as a dict: the ids of each chunk as bytes.

    The vocabulary drops white space and never joins tokens across it, so a
    text's ids are those of its blank-separated chunks in turn, and a chunk of
    letters and closing ASCII marks is its letters and then its marks.  Each
    distinct chunk is tokenised once; ids are unsigned 32-bit numbers of the
    machine, little-endian on all that Spark runs on.
    """

    def __init__(self, path: str = VOCABULARY, cache: int = CACHE):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model
        self._cache = cache
        self._parts: dict[str, bytes] = {}

    def _letters(self, run: str) -> bytes | None:
        """A run of letters is one word for the merges; None if the short way does not hold for it."""
        if not run.isascii():
            # below U+0250 a letter's lower case does not depend on its place
            run = run.lower()
            if max(run) >= "\u0250" or not run.isalpha() or not is_normalized("NFC", run):
                return None
            run = run.encode().decode("latin-1").translate(_VISIBLE)
        return array("I", [t.id for t in self._model.tokenize(run)]).tobytes()

    def _any(self, part: str) -> bytes:
        return array("I", self._tokenizer.encode(part, add_special_tokens=False).ids).tobytes()

    def _part(self, part: str) -> bytes:
        ids = self._parts.get(part)
        if ids is None:
            if len(self._parts) >= self._cache:
                self._parts.clear()
            ids = (self._letters(part) if part.isalpha() else None) or self._any(part)
            self._parts[part] = ids
        return ids

    def __missing__(self, chunk: bytes) -> bytes:
        text = chunk.decode("utf-8", "replace")
        if "<|" in text:  # special tokens are matched before letters are lowered
            ids = self._any(text)
        else:
            low = text.lower() if text.isascii() else text.translate(_LOWER)
            letters = low.rstrip(_MARKS)
            if len(letters) < len(low) and letters.isalpha() and letters.lower().isalpha():
                ids = self._part(letters) + self._part(low[len(letters):])
            else:
                ids = self._part(low)
        if len(self) >= self._cache:
            self.clear()
        self[chunk] = ids
        return ids

    def ids(self, text: bytes) -> bytes:
        """Ids of a UTF-8 text."""
        return b"".join(map(self.__getitem__, text.split()))


def cut(docs: DataFrame, id_col: str, text_col: str, capacity: int = CAPACITY, path: str = VOCABULARY) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32."""
    kind = T.StructType([
        T.StructField("id", docs.schema[id_col].dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
    ])

    def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = ChunkTokenizer(path)
        end = np.asarray([END_ID], "<u4").tobytes()
        for batch in batches:
            rows: list[tuple[int, int, int, int, int]] = []
            for row, text in enumerate(utf8(batch.column(1))):
                ids = tokenizer.ids(text) + end
                for number, start in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[start : start + 4 * capacity]
                    rows.append((row, number, start // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(columns[0], pa.int64())), pa.array(columns[1], pa.int32()),
                *[pa.array(c, pa.int64()) for c in columns[2:]],
            ], ["id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(pieces, kind)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Groups of equal sequences: (how many, [(length, how many of it in each), ...])."""
    left = {length: n for length, n in counts.items() if n > 0}
    groups: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    gaps: list[int] = []
    waiting: set[int] = set()

    def put(gap: int, many: int, content: list[tuple[int, int]]) -> None:
        if many:
            groups.setdefault(gap, []).append((many, content))
            if gap not in waiting:
                waiting.add(gap)
                heapq.heappush(gaps, gap)

    large = sorted((x for x in left if 3 * x > capacity), reverse=True)
    for length in large:
        while left[length]:
            partner = next((x for x in large if x <= min(length, capacity - length) and left[x] > (x == length)), None)
            if partner is None:
                put(capacity - length, left[length], [(length, 1)])
                left[length] = 0
            elif partner == length:
                put(capacity - 2 * length, left[length] // 2, [(length, 2)])
                left[length] %= 2
            else:
                many = min(left[length], left[partner])
                put(capacity - length - partner, many, [(length, 1), (partner, 1)])
                left[length] -= many
                left[partner] -= many
    for length in sorted((x for x in left if 3 * x <= capacity), reverse=True):
        items = left[length]
        # gaps are sorted anew for each length: there are no more of them than tokens in a sequence
        gaps.sort()
        for gap in [g for g in gaps if g >= length]:
            if not items:
                break
            each = gap // length
            held = groups.pop(gap)
            waiting.discard(gap)
            gaps.remove(gap)
            while held:
                many, content = held.pop()
                full = min(many, items // each)
                put(gap - each * length, full, [*content, (length, each)])
                items -= full * each
                rest = many - full
                if rest and items:  # fewer than one sequence takes
                    put(gap - items * length, 1, [*content, (length, items)])
                    rest, items = rest - 1, 0
                put(gap, rest, content)
                if not items:
                    for other in held:
                        put(gap, *other)
                    break
        if items:
            each = capacity // length
            put(capacity - each * length, items // each, [(length, each)])
            if items % each:
                put(capacity - items % each * length, 1, [(length, items % each)])
    return [group for gap in sorted(groups) for group in groups[gap]]


def places(groups: list[tuple[int, list[tuple[int, int]]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, how many in each sequence, first sequence, offset) for runs of pieces."""
    rows, used, sequence = [], {}, 0
    for many, content in groups:
        offset = 0
        for length, each in content:
            first = used.get(length, 0)
            used[length] = first + many * each
            rows.append((length, first, used[length], each, sequence, offset))
            offset += length * each
        sequence += many
    return rows


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, path: str = VOCABULARY
) -> DataFrame:
    """Where each piece of each document goes.

    One row per piece: ``id_col``, piece, start, length, ids_crc32,
    sequence_id, offset.  A document is its token ids and then id 0.

    * Null and empty texts are one piece of length 1.
    * Only documents over ``capacity`` are cut, into full pieces and a rest.
    * Rows that repeat an id are packed each on its own; pieces of equal length
      are interchangeable, so ties do not change the number of sequences.
    * An empty table gives an empty result; other columns take no part.
    """
    spark = docs.sparkSession
    pieces = settle(cut(docs, id_col, text_col, capacity, path), "pack-pieces")
    # at most ``capacity`` rows
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    kind = "length long, first long, until long, each long, sequence long, place long"
    runs = places(plan(counts, capacity))
    ranked = running(pieces.withColumn("one", F.lit(1).cast("long")), ["length"], ["id", "piece"], "one", "rank", buckets_for(pieces)).drop("one")
    # a run per length and group of equal sequences: bounded by the capacity, not by the documents
    table = F.broadcast(spark.createDataFrame(runs, kind).withColumnRenamed("length", "__length"))
    at = ranked.join(table, (F.col("length") == F.col("__length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("until")))
    nth = F.col("rank") - F.col("first")
    return at.select(
        F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32",
        (F.col("sequence") + F.expr("(rank - first) div each")).alias("sequence_id"),
        (F.col("place") + F.pmod(nth, F.col("each")) * F.col("length")).alias("offset"),
    )
