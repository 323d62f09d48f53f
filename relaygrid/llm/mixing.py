"""Mixing sources to target weights.

Native: DataFrame functions only.  Each source's documents form one stream of
words, cut into blocks of fixed length.  A source gives as many slots as its
target asks for.  Every slot draws its output shard, so a shard's counts per
source are multinomial, conditioned on the source totals that the targets fix
(free totals would scatter around the targets).  Slot ``k`` of a source reads
block ``order(k mod blocks)``, where ``order`` is a keyed permutation of the
source's block numbers.

The permutation is a swap-or-not shuffle (Hoang, Morris, Rogaway 2012): a
bijection on any domain, computed per block by hashing.  It is its own inverse
when its rounds run backwards, so a document finds the slots of its own blocks
without a join; the only shuffles are those of the word offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from relaygrid.llm.common import WORD, buckets_for, carried, running
from relaygrid.session import settle

BLOCK_WORDS = 64
ROUNDS = 20
SLOTS_PER_SHARD = 4096


def word_count(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(f"({WORD})")), F.lit(0)).cast("long")


def slot_of_block(block: Column, blocks: Column, key: Column, rounds: int = ROUNDS) -> Column:
    """Where a block stands in the source's shuffled order: a bijection on [0, blocks)."""

    def swap(x: Column, i: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(key, i), blocks) - x, blocks)
        toss = F.pmod(F.xxhash64(key, i, F.greatest(x, partner)), F.lit(2))
        return F.when(toss == 1, partner).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), block.cast("long"), swap)


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Target words of each source.

    ``sizes`` has one row per source: source, source_size.  Sources in code
    point order, null last, take ``weights`` in turn and share ``share`` times
    all words; no target exceeds ``most`` times its source's size, and what is
    cut is shared anew by weight.  That ends at min(most * size, level *
    weight); the level comes from one pass over the sources ordered by the
    level at which they fill up.  Works on one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weighed = sizes.select(
        "source", "source_size",
        F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")).alias("weight"),
        (F.col("source_size") * F.lit(float(most))).alias("full"),
    ).withColumn("fills_at", F.col("full") / F.col("weight"))
    order = Window.orderBy("fills_at", F.col("source").asc_nulls_last())
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    level = (
        F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("full").over(before), F.lit(0.0))
    ) / F.sum("weight").over(after)
    found = weighed.withColumn("level", level)
    # the first source that the level does not fill fixes the level of all that follow
    open_level = F.min(F.when(F.col("level") <= F.col("fills_at"), F.struct("fills_at", "level"))).over(everything)["level"]
    return found.withColumn("open_level", open_level).select(
        "source", "source_size", "weight",
        F.when(F.col("open_level").isNull(), F.col("full")).otherwise(F.least("full", F.col("open_level") * F.col("weight"))).alias("target"),
    )


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: int = 2,
    block_words: int = BLOCK_WORDS, slots_per_shard: int = SLOTS_PER_SHARD, seed: int = 7,
) -> DataFrame:
    """The mix, seen from the documents.

    One row per input row: ``id_col``, source, size (its words), source_size,
    target, and ``spans``: what the mix reads of it, as (shard, slot, block,
    pass, start, words), where ``start`` is the first word's place in the
    document.  A block is read at most ``most`` times, once per pass.

    * Null text has size 0 and no spans; a null source is a source of its own.
    * Order within a source follows a hash of the id, then the id; rows that
      repeat an id stand side by side.  Equal inputs give equal mixes.
    * An empty table gives an empty result; other columns take no part.
    """
    sized = settle(
        docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")), "mix-sizes"
    )
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # as many slots as bring the source nearest to its target, if blocks have their mean length
    plan = targets(sizes, weights, share, float(most)).withColumns({
        "blocks": F.ceil(F.col("source_size") / F.lit(block_words)),
    }).withColumn(
        "slots", F.when(F.col("blocks") > 0, F.round(F.col("target") * F.col("blocks") / F.col("source_size"))).otherwise(0).cast("long")
    )
    plan = settle(plan, "mix-plan")
    shards = F.greatest(F.ceil(F.lit((plan.agg(F.sum("slots")).first()[0] or 0) / slots_per_shard)), F.lit(1))
    placed = running(sized, ["source"], ["id", "size"], "size", "begin", buckets_for(sized))
    joined = placed.join(plan.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    key = F.xxhash64(F.lit(seed), F.coalesce(F.col("source"), F.lit("")), F.col("source").isNull())
    length = F.lit(block_words)
    end = F.col("begin") + F.col("size")
    first, last = F.floor(F.col("begin") / length), F.floor((end - 1) / length)

    def spans(block: Column) -> Column:
        start = F.greatest(block * length, F.col("begin"))
        count = F.least((block + 1) * length, end) - start
        rank = slot_of_block(block, F.col("blocks"), F.col("key"))

        def one(turn: Column) -> Column:
            slot = rank + turn * F.col("blocks")
            return F.struct(
                F.pmod(F.xxhash64(F.col("key"), F.lit("shard"), slot), F.col("shards")).alias("shard"), slot.alias("slot"),
                block.alias("block"), turn.cast("int").alias("pass"), (start - F.col("begin")).alias("start"), count.alias("words"),
            )

        passes = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(most - 1).cast("long")), one)
        return F.filter(passes, lambda s: s["slot"] < F.col("slots"))

    ranges = F.when(F.col("size") > 0, F.flatten(F.transform(F.sequence(first, last), spans)))
    kind = "array<struct<shard:bigint,slot:bigint,block:bigint,pass:int,start:bigint,words:bigint>>"
    return joined.withColumns({"key": key, "shards": shards}).select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target",
        F.coalesce(ranges.cast(kind), F.array().cast(kind)).alias("spans"),
    )


def shard_rows(mixed: DataFrame, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """The mix seen from the shards: one row per span, with the slot it fills."""
    return mixed.select(id_col, source_col, F.explode("spans").alias("span")).select(id_col, source_col, "span.*")


def shard_counts(mixed: DataFrame, source_col: str = "source") -> DataFrame:
    """Slots drawn per shard and source."""
    rows = mixed.select(source_col, F.explode("spans").alias("span"))
    # the document in which a slot's block begins stands for the slot: a slot is counted once
    return rows.groupBy("span.shard", source_col).agg(F.count_distinct("span.slot").alias("slots"))


def mixed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """``docs`` as the mix reads them; columns as they were.

    One row per document and pass that reads any of it: the text as it was if
    the pass reads all its words, else the words read, joined by one space.
    Documents of no words are none of the mix's business and stay as they are.
    """
    mixed = mix(docs, id_col, text_col, source_col, **options)
    # rows that repeat an id, a source and a size read alike: the n-th row takes the n-th reading
    # never null, so null parts are parts as any other; of one type on both sides, so neither is dealt out twice
    kinds = [docs.schema[c].dataType.simpleString() for c in (id_col, source_col)]
    key = F.struct("id", "source", "size").cast(f"struct<id:{kinds[0]},source:{kinds[1]},size:bigint>").alias("key")
    nth = F.row_number().over(Window.partitionBy("key").orderBy("tie"))
    reads = mixed.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), "size", "spans")
    reads = reads.select(key, "spans", F.xxhash64("spans").alias("tie")).withColumn("r_nth", nth).drop("tie")
    rows = docs.select(
        carried(docs), F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
        F.xxhash64(F.col(text_col)).alias("tie"),
    ).select("row", key, "tie").withColumn("nth", nth)
    # not an equality, so both sides stay dealt by the key that ranked them
    both = rows.join(reads, "key").where((F.col("nth") >= F.col("r_nth")) & (F.col("nth") <= F.col("r_nth")))
    size, text = F.col("key")["size"], F.col("row")[text_col]
    turns = F.when(size == 0, F.array(F.lit(0))).otherwise(F.array_sort(F.array_distinct(F.col("spans")["pass"])))
    each = both.withColumn("turn", F.explode(turns)).withColumn("now", F.filter("spans", lambda s: s["pass"] == F.col("turn")))
    taken = F.aggregate("now", F.lit(0).cast("long"), lambda total, s: total + s["words"])
    parts = F.when(taken != size, F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)))
    # out of a generator the text is split once, not once per span
    split = each.withColumn("parts", F.explode(F.array(parts)))
    cut = F.array_join(F.flatten(F.transform("now", lambda s: F.slice("parts", (s["start"] + 1).cast("int"), s["words"].cast("int")))), " ")
    read = F.when(F.col("parts").isNull(), text).otherwise(cut)
    return split.withColumn("read", read).select(F.col("row").withField(f"`{text_col}`", F.col("read")).alias("row")).select("row.*")
