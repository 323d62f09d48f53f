"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class is a Gaussian whose covariance is shrunk towards the diagonal of the
pooled variances.  Counts, sums and sums of products per class are one Spark
aggregate over all labelled rows, so the fit needs no sample; the driver only
sees two small matrices, factors them once (Cholesky) and writes the inverse
factors into the scoring expression.  Scores are the log-density difference of
the classes plus the log of their odds, through the logistic function.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relaygrid.llm.common import carried, remainder, utf8
from relaygrid.session import settle

#: Words and bytes of typical text that every document counts beside its own, so that short texts look typical.
PRIOR_WORDS, PRIOR_BYTES, TYPICAL_LENGTH = 20, 120, 6.0
FEATURES = ("signs", "bars", "calls", "capitals", "repeats", "variety", "words", "word_length", "digits", "lines", "stops")
SHRINKAGE = 0.1

_SIGNS, _STOPS = np.frombuffer(b"#$%&*+<=>@\\^_`~{}[]", np.uint8), np.frombuffer(b".,;:?", np.uint8)


def describe(text: bytes) -> tuple[float, ...]:
    """The transformed statistics of one whole text."""
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()
    n, size = len(words) + PRIOR_WORDS, len(text) + PRIOR_BYTES
    capitals, letters = int(seen[65:91].sum()), int(seen[65:91].sum() + seen[97:123].sum()) + PRIOR_BYTES
    repeats = sum(map(eq, words, words[1:]))
    return (
        math.sqrt(int(seen[_SIGNS].sum()) / size),
        math.sqrt(int(seen[ord("|")]) / n),
        math.sqrt(int(seen[ord("!")]) / n),
        math.sqrt(capitals / letters),
        math.sqrt(repeats / n),
        math.log((len(set(words)) + PRIOR_WORDS) / n),
        math.log(n),
        math.log((sum(map(len, words)) + TYPICAL_LENGTH * PRIOR_WORDS) / n),
        math.sqrt(int(seen[48:58].sum()) / size),
        math.sqrt((int(seen[10]) + 1) / n),
        math.sqrt((int(seen[_STOPS].sum()) + 2) / n),
    )


@F.arrow_udf(T.StructType([T.StructField(f, T.DoubleType()) for f in FEATURES]))
def statistics(text: pa.Array) -> pa.Array:
    columns = list(zip(*map(describe, utf8(text)), strict=True)) or [()] * len(FEATURES)
    return pa.StructArray.from_arrays([pa.array(c, pa.float64()) for c in columns], list(FEATURES))


@dataclass(frozen=True)
class Discriminant:
    """Class means, inverse Cholesky factors, and the constant of the log-density difference; None: no fit, ``share`` is the score."""

    means: tuple | None
    factors: tuple | None
    constant: float
    share: float

    def score(self, features: Column) -> Column:
        """Probability of class 1."""
        if self.means is None:
            return F.lit(self.share)
        distance = []
        for mean, factor in zip(self.means, self.factors, strict=True):
            centred = [features[f] - F.lit(float(m)) for f, m in zip(FEATURES, mean, strict=True)]
            total = F.lit(0.0)
            for i, row in enumerate(factor):
                white = F.lit(0.0)
                for j in range(i + 1):
                    white = white + centred[j] * F.lit(float(row[j]))
                total = total + white * white
            distance.append(total)
        odds = (distance[0] - distance[1]) * F.lit(0.5) + F.lit(self.constant)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.least(odds, F.lit(700.0)), F.lit(-700.0))))


def fit(labelled: DataFrame, shrinkage: float = SHRINKAGE) -> Discriminant:
    """Fit from rows (features, label in 0/1).  With fewer than two rows of a class there is no fit."""
    x = [F.col("features")[f] for f in FEATURES]
    d = len(x)
    pairs = [(i, j) for i in range(d) for j in range(i + 1)]
    sums = [F.sum(c).alias(f"s{i}") for i, c in enumerate(x)] + [F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i, j in pairs]
    rows = {r["label"]: r for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n"), *sums).collect()}
    counts = [rows[k]["n"] if k in rows else 0 for k in (0, 1)]
    share = (counts[1] + 1) / (sum(counts) + 2)
    if min(counts) < 2:
        return Discriminant(None, None, 0.0, share)
    means, spreads = [], []
    for k in (0, 1):
        r, n = rows[k], counts[k]
        mean = np.array([r[f"s{i}"] / n for i in range(d)])
        product = np.zeros((d, d))
        for i, j in pairs:
            product[i, j] = product[j, i] = r[f"p{i}_{j}"] / n
        means.append(mean)
        spreads.append(product - np.outer(mean, mean))
    pooled = (counts[0] * np.diag(spreads[0]) + counts[1] * np.diag(spreads[1])) / sum(counts)
    target = np.diag(np.maximum(pooled, 1e-6))
    factors, logs = [], []
    for spread in spreads:
        lower = np.linalg.cholesky((1 - shrinkage) * spread + shrinkage * target)
        factors.append(tuple(map(tuple, np.linalg.inv(lower))))
        logs.append(float(np.log(np.diag(lower)).sum()))
    return Discriminant(tuple(map(tuple, means)), tuple(factors), logs[0] - logs[1] + math.log(counts[1] / counts[0]), share)


def learn(described: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> Discriminant:
    """Fit on the described rows (``id_col``, features) that have a label and are not held out."""
    known = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("label"))
    train = described.where(remainder(F.col(id_col), 3) != 1).select(F.col(id_col).alias("__id"), "features")
    return fit(train.join(known, "__id"))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Score every whole text: one row per input row with ``id_col``, held_out, score, predicted.

    * Labels teach only through rows whose crc32(id) mod 3 is not 1 (``held_out``
      marks the others); a label given twice counts twice, null labels not at all.
    * Null text counts as empty; an empty text looks like typical text.
    * Without two rows of each class every score is the smoothed share of label 1.
    * An empty table gives an empty result; other columns take no part.
    """
    described = settle(docs.select(F.col(id_col).alias(id_col), statistics(F.col(text_col)).alias("features")), "quality-statistics")
    score = learn(described, labels, id_col, label_col).score(F.col("features"))
    held = (remainder(F.col(id_col), 3) == 1).alias("held_out")
    return described.select(id_col, held, score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """``docs`` without the rows predicted to be of low quality; columns as they were.

    The text is read twice, to learn and to judge, and never shuffled.
    """
    described = settle(docs.select(F.col(id_col).alias(id_col), statistics(F.col(text_col)).alias("features")), "quality-statistics")
    model = learn(described, labels, id_col, label_col)
    judged = docs.select(carried(docs), statistics(F.col(text_col)).alias("features"))
    return judged.where(model.score(F.col("features")) >= 0.5).select("row.*")
