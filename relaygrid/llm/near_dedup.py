"""MinHash near-dedup over word shingles.

1. Each document's distinct shingles give many universal-hash minima; groups of
   minima are band keys, and one byte of each minimum is kept as signature.
2. Documents of one shingle set form one class, represented by the smallest id.
3. Candidates: in each band bucket every representative is paired with the
   bucket's smallest id, never with all others.  Pairs pass if their signatures
   agree (with a margin no true link misses) and if their full shingle sets,
   built from the texts, are similar enough.
4. Components of the links by large-star and small-star.
5. Buckets that still hold several components may hide links between members
   that are not their smallest: there, members outside the bucket's main
   component meet all others, in blocks of bounded size.  Signatures first tell
   which members have a likely partner in another component; these alone come
   with their texts, and full sets are compared inside the task, by products of
   their incidence matrices.  A task reports links that join what was not yet
   joined, fewer than it has members.

So a bucket costs rows in proportion to its members, unless it holds many
components, and no link between documents that share a band is lost.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relaygrid.llm.common import carried, utf8
from relaygrid.llm.components import components
from relaygrid.session import settle

#: 42 bands of 6 minima: two documents with a similarity of 0.8 share no band in 3 of a million cases.
BANDS, ROWS = 42, 6
#: How far a signature's share of equal bytes may fall below the threshold: over five standard deviations at 252 minima.
MARGIN = 0.14
#: Members of a bucket on either side of one comparison, and their shingles in all.
BLOCK, BLOCK_SHINGLES = 1024, 4_000_000
CACHE = 400_000
#: Bits of the filter that texts pass on their way to an exact join: 4 MB.
FILTER_BITS = 25

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: list[bytes], known: dict[bytes, int], size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; fewer words than ``size`` are one shingle, none is none."""
    if not words:
        return np.empty(0, np.uint64)
    codes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    size = min(size, len(words))
    n = len(words) - size + 1
    rolled = np.full(n, size, np.uint64)
    for place in range(size):
        rolled = (rolled ^ codes[place : place + n]) * _M1
        rolled ^= rolled >> np.uint64(29)
    return np.unique(_mixed(rolled))


@lru_cache
def _family(n: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20240229)
    return draw.integers(0, 1 << 31, n, np.uint32) * np.uint32(2) + np.uint32(1), draw.integers(0, 1 << 32, n, np.uint32)


def minima(hashes: np.ndarray, n: int = BANDS * ROWS) -> np.ndarray:
    """Minimum of each of ``n`` universal hash functions over a set that is not empty."""
    a, b = _family(n)
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(n, 0xFFFFFFFF, np.uint32)
    for start in range(0, len(x), 512):
        part = x[None, start : start + 512] * a[:, None]
        part += b[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    rows = least.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * _M1
    for place in range(ROWS):
        key = _mixed((key ^ rows[:, place]) * _M1)
    return key.view(np.int64)


def _signed(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """id, n_shingles, print (of the set; null for none), bands, signature."""
    kind = T.StructType([
        T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_shingles", T.LongType()), T.StructField("print", T.BinaryType()),
        T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("signature", T.BinaryType()),
    ])

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHash()
        for batch in batches:
            counts, prints, bands, signatures = [], [], [], []
            for text in utf8(batch.column(1)):
                hashes = shingle_hashes(text.lower().split(), known, size)
                counts.append(len(hashes))
                if not len(hashes):
                    prints.append(None), bands.append(None), signatures.append(None)
                    continue
                least = minima(hashes)
                prints.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                bands.append(band_keys(least))
                signatures.append(((least * np.uint32(2654435761)) >> np.uint32(24)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(counts, pa.int64()), pa.array(prints, pa.binary()), pa.array(bands, pa.list_(pa.int64())),
                pa.array(signatures, pa.binary()),
            ], ["id", "n_shingles", "print", "bands", "signature"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(sign, kind)


@F.arrow_udf(T.DoubleType())
def _agree(a: pa.Array, b: pa.Array) -> pa.Array:
    left, right = (np.frombuffer(b"".join(x.to_pylist()), np.uint8).reshape(len(x), -1) for x in (a, b))
    return pa.array(((left == right).mean(axis=1) - 1 / 256) * 256 / 255 if len(a) else [], pa.float64())


def shingles(text: bytes, size: int) -> set[tuple[bytes, ...]]:
    words = text.lower().split()
    size = min(size, len(words))
    return set(zip(*[words[place:] for place in range(size)], strict=False)) if words else set()


def _confirm(size: int, percent: int):
    @F.arrow_udf(T.BooleanType())
    def confirm(a: pa.Array, b: pa.Array) -> pa.Array:
        cached = lru_cache(maxsize=2)(lambda text: shingles(text, size))  # one of a pair comes many times in turn
        found = []
        for left, right in zip(utf8(a), utf8(b), strict=True):
            one, two = cached(left), shingles(right, size)
            both = len(one & two)
            found.append(100 * both >= percent * (len(one) + len(two) - both) > 0)
        return pa.array(found, pa.bool_())

    return confirm


def _texts(docs: DataFrame, id_col: str, text_col: str, ids: DataFrame) -> DataFrame:
    """id, text of the given ids; an id that repeats with other texts has several sets, and any of them links."""
    ids = settle(ids, "near-wanted")
    rows = _perhaps_wanted(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), ids)
    return settle(rows.join(ids, "id", "left_semi"), "near-texts")


def _perhaps_wanted(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` without most of those whose id is not among ``ids``: a filter before the exact join, of fixed size.

    A bitmap of hashed ids, 2 ** FILTER_BITS bits in all, however many ids there
    are: where they are very many it lets more rows through to the join, never fewer.
    """
    place = F.pmod(F.xxhash64("id"), F.lit(1 << FILTER_BITS)) + 1
    bits = ids.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("slice")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    bits = F.broadcast(settle(bits, "near-filter"))  # at most 2 ** FILTER_BITS / 8 bytes
    met = rows.withColumn("p", place).withColumn("slice", F.bitmap_bucket_number("p")).join(bits, "slice")
    at = F.bitmap_bit_position("p")
    byte = F.conv(F.hex(F.expr("substring(bits, cast(bitmap_bit_position(p) div 8 as int) + 1, 1)")), 16, 10).cast("bigint")
    return met.where(F.getbit(byte, (at % 8).cast("int")) == 1).select("id", "text")


def _close(pairs: DataFrame, signatures: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose signatures agree."""
    left = signatures.select(F.col("id").alias("a"), F.col("signature").alias("sa"))
    right = signatures.select(F.col("id").alias("b"), F.col("signature").alias("sb"))
    near = pairs.join(left, "a").join(right, "b").where(_agree("sa", "sb") >= percent / 100 - MARGIN)
    return settle(near.select("a", "b").distinct(), "near-close")


def _confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar."""
    first = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    both = first.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    return settle(both.where(_confirm(size, percent)("ta", "tb")).select("a", "b"), "near-links")


def _likely(percent: int):
    """Members of a group that have a likely partner on the other side; see :func:`_across`."""
    low = percent / 100 - MARGIN

    def likely(key: tuple, table: pa.Table) -> pa.Table:
        asks = np.asarray(table["asks"])
        ids, size = np.array(table["id"].to_pylist(), object), np.asarray(table["n_shingles"])
        _, group = np.unique(np.array(table["component"].to_pylist(), object), return_inverse=True)
        codes = np.frombuffer(b"".join(table["signature"].to_pylist()), np.uint8).reshape(len(ids), -1)
        mine, others, met = np.flatnonzero(asks), np.flatnonzero(~asks), np.zeros(len(ids), bool)
        for i in mine:
            # sets of such different sizes cannot be similar
            apart = group[others] != group[i]
            apart &= 100 * np.minimum(size[others], size[i]) >= percent * np.maximum(size[others], size[i])
            near = others[apart]
            share = ((codes[near] == codes[i]).mean(axis=1) - 1 / 256) * 256 / 255
            near = near[share >= low]
            met[near] = True
            met[i] = len(near) > 0
        rows = np.flatnonzero(met)
        keys = [pa.array([k.as_py()] * len(rows), k.type) for k in key]
        return pa.table([*keys, table["id"].combine_chunks().take(pa.array(rows)), pa.array(asks[rows])], names=["bucket", "low", "high", "id", "asks"])

    return likely


def _linked(size: int, percent: int):
    """Links of a group's full sets that join what is not joined yet."""

    def linked(key: tuple, table: pa.Table) -> pa.Table:
        known = _WordHash()
        sets = [shingle_hashes(t.lower().split(), known, size) for t in utf8(table["text"].combine_chunks())]
        ids, asks = table["id"].to_pylist(), np.asarray(table["asks"])
        lengths = np.array([len(x) for x in sets])
        _, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(sets)), lengths)
        shared = times[code] > 1
        code, owner = np.unique(code[shared], return_inverse=True)[1], owner[shared]
        order = np.argsort(code, kind="stable")
        code, owner = code[order], owner[order]
        mine, others = np.flatnonzero(asks), np.flatnonzero(~asks)
        both = np.zeros((len(mine), len(others)), np.float32)
        width = 2048
        for start in range(0, int(code[-1]) + 1 if len(code) else 0, width):
            first, end = np.searchsorted(code, [start, start + width])
            held = np.zeros((len(sets), width), np.float32)
            held[owner[first:end], code[first:end] - start] = 1
            both += held[mine] @ held[others].T
        union = lengths[mine][:, None] + lengths[others][None] - both
        near = 100 * both.astype(np.float64) >= percent * union.astype(np.float64)
        root = {i: i for i in ids}

        def find(i):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        out = []
        for row, column in zip(*np.nonzero(near), strict=True):
            a, b = find(ids[mine[row]]), find(ids[others[column]])
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((ids[mine[row]], ids[others[column]]))
        a, b = zip(*out, strict=True) if out else ((), ())
        kind = table.schema.field("id").type
        return pa.table({"a": pa.array(a, kind), "b": pa.array(b, kind)})

    return linked


def _across(
    members: DataFrame, reps: DataFrame, docs: DataFrame, texts: DataFrame, id_col: str, text_col: str, size: int, percent: int
) -> DataFrame:
    """Links (a, b) between components within buckets.

    ``texts``: those fetched already; only what is missing is fetched from ``docs``.

    ``members``: bucket, id, n_shingles, component.  Of each bucket the members
    outside its largest component ask all members; askers and asked are dealt
    into blocks, and each pair of blocks is one group of bounded size.
    """
    id_type = members.schema["id"].dataType
    sizes = members.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("s"))
    whole = sizes.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.max(F.struct("n", "s", "component")).alias("main"))

    def blocks(n, s):
        return F.greatest(F.ceil(n / BLOCK), F.ceil(s / BLOCK_SHINGLES), F.lit(1)).cast("int")

    whole = whole.where(F.col("n") > F.col("main")["n"]).select(
        "bucket", F.col("main")["component"].alias("main"),
        blocks(F.col("n") - F.col("main")["n"], F.col("s") - F.col("main")["s"]).alias("lows"), blocks(F.col("n"), F.col("s")).alias("highs"),
    )
    open_ = settle(members.join(whole, "bucket"), "near-open")
    keys = ["bucket", "low", "high"]

    def every(count):
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    asking = open_.where("component != main").withColumns({
        "low": F.pmod(F.xxhash64("id"), F.col("lows")).cast("int"), "high": every("highs"), "asks": F.lit(True),
    })
    asked = open_.withColumns({"low": every("lows"), "high": F.pmod(F.xxhash64("id"), F.col("highs")).cast("int"), "asks": F.lit(False)})
    columns = [*keys, "id", "n_shingles", "component", "asks"]
    met = asking.select(columns).unionByName(asked.select(columns)).join(reps.select("id", "signature"), "id")
    kind = T.StructType([
        T.StructField("bucket", T.LongType()), T.StructField("low", T.IntegerType()), T.StructField("high", T.IntegerType()),
        T.StructField("id", id_type), T.StructField("asks", T.BooleanType()),
    ])
    likely = settle(met.groupBy(*keys).applyInArrow(_likely(percent), kind), "near-likely")
    # groups of the same members are compared once
    alike = likely.groupBy(*keys).agg(F.bit_xor(F.xxhash64("id", "asks")).alias("x"), F.count(F.lit(1)).alias("n"), F.min("id").alias("i"))
    once = alike.groupBy("x", "n", "i").agg(F.min(F.struct(*keys)).alias("k")).select("k.*")
    chosen = settle(likely.join(once, keys, "left_semi"), "near-chosen")
    missing = chosen.select("id").distinct().join(texts.select("id").distinct(), "id", "left_anti")
    texts = texts.unionByName(_texts(docs, id_col, text_col, settle(missing, "near-missing")))
    pair = T.StructType([T.StructField("a", id_type), T.StructField("b", id_type)])
    return settle(chosen.join(texts, "id").groupBy(*keys).applyInArrow(_linked(size, percent), pair), "near-links")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """Groups of near copies: one row per input row with ``id_col``, n_shingles, component_id, kept.

    Words are runs of characters other than blanks, A-Z lower-cased.  Documents
    whose sets of distinct ``size``-word shingles have ``percent`` of their
    union in common are linked; component_id is the smallest id reachable.

    * Fewer words than ``size`` are one shingle; without words a row is linked
      with nothing and is its own component.
    * Rows that share an id are one document with several texts.
    * A null id takes part in no link but that of equal sets: such a row has
      the component of a row with an id and the same set, or null.
    * An empty table gives an empty result; other columns take no part.
    """
    signed = settle(_signed(docs, id_col, text_col, size), "near-signed")
    classes = settle(signed.where("print is not null").groupBy("print").agg(F.min("id").alias("rep")), "near-classes")
    chosen = classes.where("rep is not null").select("print", F.col("rep").alias("id"))
    reps = settle(signed.join(chosen, ["print", "id"], "left_semi").dropDuplicates(["print", "id"]).select("id", "n_shingles", "bands", "signature"), "near-reps")
    signatures = reps.select("id", "signature")
    in_bands = reps.select(F.explode("bands").alias("bucket"), "id", "n_shingles")
    buckets = in_bands.groupBy("bucket").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count(F.lit(1)).alias("n"))
    shared = settle(in_bands.join(buckets.where("least != most").select("bucket", "least", "n"), "bucket"), "near-buckets")
    pairs = shared.where("id != least").select(F.col("least").alias("a"), F.col("id").alias("b")).distinct()
    close = _close(pairs, signatures, percent)
    texts = _texts(docs, id_col, text_col, close.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    links = _confirmed(close, texts, size, percent)
    # ids that stand for several sets link those sets
    repeated = signed.where("print is not null and id is not null").join(classes, "print").where("rep != id").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    found = components(links.unionByName(_same_id(signed, repeated)))
    of = found.select(F.col("node").alias("id"), "component")
    members = shared.where("n > 2").join(of, "id", "left").select("bucket", "id", "n_shingles", F.coalesce("component", "id").alias("component"))
    more = _across(members, reps, docs, texts, id_col, text_col, size, percent)
    if not more.isEmpty():
        found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    of = found.select(F.col("node").alias("rep"), "component")
    at = classes.join(of, "rep", "left").select("print", F.coalesce("component", "rep").alias("component_id"))
    rows = signed.select("id", "n_shingles", "print").join(at, "print", "left")
    component = F.when(F.col("print").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return rows.select(
        F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept")
    )


def _same_id(signed: DataFrame, repeated: DataFrame) -> DataFrame:
    """Links between the classes of ids that stand for more than one set."""
    several = signed.where("print is not null and id is not null").groupBy("id").agg(F.count_distinct("print").alias("sets")).where("sets > 1")
    return repeated.join(several.select(F.col("id").alias("a")), "a", "left_semi")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group; columns as they were.

    Rows without an id stay; of rows that repeat both id and text one stays.
    """
    gone = near_dedup(docs, id_col, text_col, size, percent).where(~F.col("kept") & F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"))
    row = docs.select(carried(docs), F.col(id_col).alias("__id"))
    stay = row.join(gone, "__id", "left_anti")
    return stay.withColumn("__text", F.xxhash64(F.col("row")[text_col])).dropDuplicates(["__id", "__text"]).select("row.*")
