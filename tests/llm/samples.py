"""Small tables with every oddity the operators define."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

#: Names that operators use for themselves; as further columns they must not matter.
CLASHES = ("id", "row", "hash", "norm", "sha", "n", "size", "spans", "component", "features", "bucket", "key", "part", "rank", "word", "begin", "nth")
KIND = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in CLASHES)


def prose(seed: int, words: int) -> str:
    draw = random.Random(seed)
    return " ".join(draw.choice(("stone", "river", "of", "the", "walks", "under", "green", "sky", "and", "Quick", "house")) + draw.choice(("", "", ",", ".", "s")) for _ in range(words))


def rows() -> list[tuple]:
    base = prose(1, 60)
    near = base.split()
    near[30] = "changed"
    texts = [
        (1, base, "en", "a"), (2, None, "en", "a"), (3, "", None, "b"), (4, " \t\r\n\x0b\x0c ", "en", None), (5, prose(2, 30_000), "en", "a"),
        (6, base.replace(" ", " \n "), "en", "b"), (7, " ".join(near), "en", None), (7, " ".join(near), "en", None), (8, "one", "de", "c"),
        (9, "ONE", "de", "c"), (10, "Straße é ü 日本 \x85 \xa0x", "de", None), (None, base, None, "a"), (None, "no id here at all", "en", "z"),
        (11, "1234 5678 !!", "en", "c"), (12, base, "en", "c"), (13, "it's <|endoftext|> done", "en", "a"),
    ]
    return texts


def docs(spark: SparkSession, data: list[tuple] | None = None) -> DataFrame:
    data = rows() if data is None else data
    return spark.createDataFrame([(*r, *[f"{c}!" for c in CLASHES]) for r in data], KIND)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], KIND)
