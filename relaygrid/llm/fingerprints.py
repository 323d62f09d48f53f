"""Document fingerprints by consistent weighted sampling.

Native: DataFrame functions only.

A document is a weighted set: its words, weighted by how often they occur.  For
each of ``samples`` positions every term draws, by hashes of term and position
alone, r and c from Gamma(2, 1) and b from U(0, 1).  With weight w it offers
the step t = floor(ln w / r + b) at the cost ln a = ln c - r (t - b + 1); the
position takes the (term, t) of least cost.  Two documents take the same one
with a probability of exactly sum(min(w, v)) / sum(max(w, v)), the generalised
Jaccard similarity.

The draws of a term serve a document and its edited form at once, as both are
made of much the same words.  Texts are dealt out once, into slots of
neighbouring ids; words, minima and comparisons then stay in the slot's task.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from relaygrid.llm.common import BLANKS
from relaygrid.session import settle

SAMPLES = 80
#: Rows of a slot, and how many slots there are at most; beyond it slots grow (their starts are part of the plan and travel to every task).
SLOT_ROWS, MOST_SLOTS = 128, 4_096
#: Two hashes of 64 bits give four uniforms of 26 bits and one of 24.
_BITS = 26
_SQUARE = float(1 << (2 * _BITS))
#: Costs are compared in steps of 2^-24; below them stand 31 bits that name (term, t).
_COST_STEPS, _NAME_BITS = float(1 << 24), 31
#: Bits of a taken sample that enter the fingerprint; two others agree by chance once in 65,536.
_SHOWN_BITS = 16
#: A position takes an offer below ENOUGH / total weight; once in e^40 positions none comes, and a sample is missing.
ENOUGH = 40.0


def _uniform(bits: Column, shift: int) -> Column:
    """26 of 64 bits as a whole number and a half, in units of 2^-26."""
    return F.shiftright(bits, shift).bitwiseAND(F.lit((1 << _BITS) - 1)).cast("double") + 0.5


def _rest(first: Column, second: Column) -> Column:
    """The 12 highest bits of both hashes as a number in (0, 1)."""
    high = F.shiftright(first, 52).bitwiseAND(F.lit(4095)) * 4096 + F.shiftright(second, 52).bitwiseAND(F.lit(4095))
    return (high.cast("double") + 0.5) / float(1 << 24)


def sampled(terms: DataFrame, keys: list[str], weights: dict[str, str], samples: int) -> DataFrame:
    """Least offers per key and position: columns keys, k and one long per weight column.

    ``terms``: keys, term (long), the weight columns and for each the total
    weight of its document; a weight of 0 offers nothing.  A position that no
    term offers to is null.

    The least cost a is exponential with the total weight as its rate, so it
    lies below ENOUGH / total but for one case in e^ENOUGH.  Terms that cannot
    come below are passed over before any logarithm, by lower bounds from the
    uniforms: with x = e^-r and y = e^-c, a >= (1 - y) x / w, and for w = 1
    a = c x^(1-b) >= (1 - y) x / (x + (1 - b)(1 - x)).
    """
    logarithms = [F.ln(F.col(w).cast("double")).alias(f"{w}_ln") for w in weights]  # ln 0 is null
    reach = F.greatest(*[F.col(w) * ENOUGH / F.col(total) for w, total in weights.items()])
    most = F.greatest(*[F.col(w) for w in weights])
    passed_on = [*keys, "k", "term", *[f"{w}_ln" for w in weights]]
    dealt = terms.select(*keys, "term", *logarithms, reach.alias("reach"), most.alias("most"), F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("k"))
    hashed = dealt.withColumn("first", F.xxhash64("term", "k")).withColumn("second", F.xxhash64("first"))
    first, second = F.col("first"), F.col("second")
    drawn = hashed.select(
        *passed_on, "reach", "most", (_uniform(first, 0) * _uniform(first, _BITS) / _SQUARE).alias("x"),
        (_uniform(second, 0) * _uniform(second, _BITS) / _SQUARE).alias("y"), _rest(first, second).alias("b"),
        # a number the filter below reads too: it keeps the optimiser from copying the draws into the filter
        F.monotonically_increasing_id().alias("drawn"),
    )
    x, y = F.col("x"), F.col("y")
    least = (1.0 - y) * x
    bound = F.when(F.col("most") == 1, least / (x + (1.0 - F.col("b")) * (1.0 - x))).otherwise(least)
    # a term without weight offers nothing, but keeps its key alive
    hopeful = (bound < F.col("reach")) | ((F.col("most") == 0) & (F.col("k") == 0))
    logs = drawn.where(hopeful & (F.col("drawn") >= 0)).select(*passed_on, (-F.ln(x)).alias("r"), F.ln(-F.ln(y)).alias("ln_c"), "b")
    stepped = logs.select(*keys, "k", "term", "r", "ln_c", "b", *[F.floor(F.col(f"{w}_ln") / F.col("r") + F.col("b")).alias(w) for w in weights])

    def offer(t: Column) -> Column:
        cost = ((F.col("ln_c") - F.col("r") * (t - F.col("b") + 1.0)) * _COST_STEPS).cast("long")
        name = F.col("term").bitwiseXOR(F.shiftleft(t, 15)).bitwiseAND(F.lit((1 << _NAME_BITS) - 1))
        return F.shiftleft(cost, _NAME_BITS).bitwiseOR(name)

    offers = stepped.select(*keys, "k", *[offer(F.col(w)).alias(w) for w in weights])
    return offers.groupBy(*keys, "k").agg(*[F.min(w).alias(w) for w in weights])


def likeness(mine: Column, other: Column) -> Column:
    """Share of positions at which two arrays of samples agree; two without terms are equal."""
    agree = F.aggregate(F.zip_with(mine, other, lambda a, b: F.coalesce((a == b).cast("int"), F.lit(0))), F.lit(0), lambda total, one: total + one)
    both, none = F.size(mine) + F.size(other), F.lit(0)
    return F.when(both == none, 1.0).when((F.size(mine) == none) | (F.size(other) == none), 0.0).otherwise(agree / F.size(mine))


def shown(samples: Column) -> Column:
    """Samples as one string of hexadecimal digits."""
    return F.array_join(F.transform(samples, lambda s: F.lpad(F.lower(F.hex(s)), _SHOWN_BITS // 4, "0")), "")


def _starts(docs: DataFrame, order: list[Column]) -> tuple[list, int]:
    """(id, tie) of the first row of each slot, in order: every ``size``-th row of all, at most :data:`MOST_SLOTS`; the rows of all."""
    total = docs.count()
    size = max(SLOT_ROWS, -(-total // MOST_SLOTS))
    parts = max(8, -(-total // 100_000))
    dealt = docs.select("id", "tie").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ids = settle(dealt.select("id", "tie", F.spark_partition_id().alias("part"), at.alias("at")), "fingerprint-order")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    bases = ids.groupBy("part").agg(F.count(F.lit(1)).alias("rows")).select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"))
    place = F.col("base") + F.col("at")
    found = ids.join(settle(bases, "fingerprint-bases"), "part").where(place % size == 0).select(place.alias("place"), "id", "tie").collect()
    starts = []
    for row in sorted(found, key=lambda r: r["place"]):
        if not starts or starts[-1] != (row["id"], row["tie"]):  # rows equal in both stay in one slot
            starts.append((row["id"], row["tie"]))
    return starts, total


def _with_next(docs: DataFrame) -> DataFrame:
    """Each document with the text of the next one by falling id; of the last one, the first.

    Texts move once: a row finds its slot by a binary search over the slots'
    starts, and the row that starts a slot also visits, as ``guest``, the slot before.
    """
    order = [F.col("id").desc_nulls_last(), F.col("tie")]
    starts, total = _starts(docs, order)
    if not starts:
        return docs.select(F.lit(0).alias("slot"), F.lit(0).alias("at"), F.lit(False).alias("guest"), "id", "text", F.col("text").alias("next"))
    kind = docs.schema["id"].dataType.simpleString()
    # a constant; the optimiser parses it once.  It stands in the plan as text too, so it is named twice only, whatever the number of steps
    listed = json.dumps([{"id": i if isinstance(i, int) or i is None else str(i), "tie": t} for i, t in starts])
    entries = F.from_json(F.lit(listed), f"array<struct<id: {kind}, tie: bigint>>")

    def at_start(place: Column, holds) -> Column:
        """Whether ``holds`` is true of one start; bound by a function, so that the list is not repeated for each use."""
        return F.exists(F.array(F.get(entries, place)), holds)

    reached = lambda start: (  # noqa: E731  (the row is the start or comes after it)
        F.when(F.col("id").eqNullSafe(start["id"]), F.col("tie") >= start["tie"])
        .when(F.col("id").isNull(), True).when(start["id"].isNull(), False).otherwise(F.col("id") < start["id"])
    )
    steps = F.array(F.lit(0), *[F.lit(1 << bit) for bit in reversed(range((len(starts) - 1).bit_length()))])
    slot = F.aggregate(steps, F.lit(0), lambda slot, step: F.when((slot + step < len(starts)) & at_start(slot + step, reached), slot + step).otherwise(slot))
    frame = docs.withColumn("slot", slot)
    visits = F.array(F.struct(F.col("slot").alias("slot"), F.lit(False).alias("guest")))
    before = F.when(F.col("slot") > 0, F.col("slot") - 1).otherwise(len(starts) - 1)
    is_start = at_start(F.col("slot"), lambda start: F.col("id").eqNullSafe(start["id"]) & (F.col("tie") == start["tie"]))
    both = F.concat(visits, F.array(F.struct(before.alias("slot"), F.lit(True).alias("guest"))))
    frame = frame.select("id", "tie", "text", F.explode(F.when(is_start, both).otherwise(visits)).alias("visit"))
    frame = frame.select("id", "tie", "text", "visit.slot", "visit.guest")
    parts = min(len(starts), max(64, total // (4 * SLOT_ROWS)))
    inside = Window.partitionBy("slot").orderBy("guest", *order)
    return frame.repartition(parts, "slot").select(
        "slot", F.row_number().over(inside).alias("at"), "guest", "id", "text", F.lead("text").over(inside).alias("next")
    )


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of every text and of its edited form, and how like they are.

    The edited text is the text with its last floor(n_chars / 2) code points
    replaced by the first as many of the next document's, by falling id (after
    the last: the first).  Columns: ``id_col``, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next.

    * Null text counts as empty.  Words are what stands between blanks, as
      written; a text without words has an empty fingerprint, equal to another
      such text's and unlike all others.
    * Null ids come last; rows that share an id follow each other by a hash of
      their text, so each repeated row has its own result row.
    * One document alone is its own next.  An empty table gives an empty
      result; other columns, whatever their names, take no part.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("tie"), text.alias("text"))
    paired = _with_next(rows)
    sized = paired.withColumn("n_chars", F.length("text"))
    edited = sized.withColumn("edited", F.when(~F.col("guest"), F.concat(
        F.expr("substring(text, 1, n_chars - CAST(floor(n_chars / 2) AS INT))"), F.expr("substring(next, 1, CAST(floor(n_chars / 2) AS INT))"),
    )))
    split = edited.withColumns({
        "own_words": F.array_remove(F.split("text", BLANKS), ""), "changed_words": F.array_remove(F.split(F.coalesce("edited", F.lit("")), BLANKS), ""),
    })
    # what a row carries along, as text: plain keys keep the aggregates in their fast form
    about = F.to_json(F.struct(F.col("id").cast("string").alias("id"), "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "guest"))

    def body(which: int, words: Column, described: Column) -> Column:
        return F.struct(F.lit(which).alias("which"), words.alias("words"), described.alias("about"))

    # two bodies of words, and one row that carries the rest
    bodies = F.array(body(0, F.col("own_words"), F.lit("")), body(1, F.col("changed_words"), F.lit("")), body(2, F.array(F.lit("")), about))
    sizes = [F.size("own_words").alias("own_total"), F.size("changed_words").alias("changed_total")]
    words = split.select("slot", "at", *sizes, F.explode(bodies).alias("b"))
    # taken apart first: a row per word must not carry all words along
    words = words.select("slot", "at", "own_total", "changed_total", "b.which", "b.about", "b.words")
    words = words.select("slot", "at", "own_total", "changed_total", "which", "about", F.explode("words").alias("word"))
    counted = words.groupBy("slot", "at", "own_total", "changed_total", "about", F.xxhash64("word").alias("term")).agg(
        F.sum(F.when(F.col("which") == 0, 1).otherwise(0)).alias("own"), F.sum(F.when(F.col("which") == 1, 1).otherwise(0)).alias("changed"),
    )
    keys = ["slot", "at", "about"]
    totals = counted.withColumns({"own_total": F.greatest("own_total", F.lit(1)), "changed_total": F.greatest("changed_total", F.lit(1))})
    least = sampled(totals, keys, {"own": "own_total", "changed": "changed_total"}, samples)
    low = F.lit((1 << _SHOWN_BITS) - 1)
    sample = F.when(F.col("about") == "", F.struct("k", F.col("own").bitwiseAND(low).alias("own"), F.col("changed").bitwiseAND(low).alias("changed")))
    gathered = least.groupBy("slot", "at").agg(F.array_sort(F.collect_list(sample)).alias("taken"), F.max("about").alias("about"))

    def taken(name: str) -> Column:
        return F.array_compact(F.transform("taken", lambda one: one[name]))

    carried = F.from_json("about", "id string, n_chars long, edited_sha256 string, guest boolean").alias("about")
    signed = gathered.select("slot", "at", carried, taken("own").alias("own"), taken("changed").alias("changed"))
    next_one = F.lead("own").over(Window.partitionBy("slot").orderBy("at"))
    return signed.withColumn("next", next_one).where(~F.col("about.guest")).select(
        F.col("about.id").cast(docs.schema[id_col].dataType).alias(id_col), "about.n_chars", "about.edited_sha256",
        shown(F.col("own")).alias("fingerprint"), shown(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"),
    )
