"""Language identification in two steps: the family, then the language within it.

Features are hashed byte n-grams (one to three) of the letters of the whole
text, as square roots of their shares, so long and short texts compare.  A
linear support vector machine per family (one against the rest) picks the
family; one machine per pair of the family's languages picks the language.
All machines are trained on the driver from a sample of bounded size.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relaygrid.llm.common import remainder, utf8

BINS = 2048
#: Rows of one language, and of all languages, that train the machines at most.
PER_LANGUAGE, IN_ALL = 600, 6000
#: Families of ISO 639-1 codes; a code that is not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "uralic": "fi et hu",
    "turkic": "tr az kk ky uz tk tt",
    "indic": "hi bn mr gu pa ne si ur or as",
    "dravidian": "ta te kn ml",
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}

# ASCII letters lower-cased, other ASCII bytes blank, bytes of longer characters as they are
_LETTERS = bytes(b if b >= 128 else (ord(chr(b).lower()) if chr(b).isalpha() else 32) for b in range(256))
_A, _B, _C = np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917)


def has_letter(text: bytes) -> bool:
    if any(97 <= b <= 122 for b in text[:64].translate(_LETTERS)):
        return True
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


def profile(text: bytes, bins: int = BINS) -> np.ndarray:
    """Square roots of the shares of hashed n-grams: a vector of length 1, or 0 for a text without letters."""
    plain = b" " + b" ".join(text.translate(_LETTERS).split()) + b" "
    codes = np.frombuffer(plain, np.uint8).astype(np.uint32)
    shift = np.uint32(32 - (bins - 1).bit_length())
    one = codes * _A
    counts = np.bincount(one >> shift, minlength=bins)
    two = (one[:-1] ^ (codes[1:] * _B)) * _C
    counts = counts + np.bincount(two >> shift, minlength=bins)
    if len(codes) > 2:
        three = (two[:-1] + codes[2:] * _A) * _B
        counts = counts + np.bincount(three >> shift, minlength=bins)
    return np.sqrt(counts / counts.sum()).astype(np.float32) if len(codes) > 2 else np.zeros(bins, np.float32)


def machine(x: np.ndarray, y: np.ndarray, cost: float = 50.0, steps: int = 150) -> np.ndarray:
    """Linear support vector machine with squared hinge loss, by accelerated gradient steps; the last weight is the bias.

    ``y`` is +1 or -1; both sides weigh the same however many rows they have.
    """
    rows = np.hstack([x, np.ones((len(x), 1), np.float32)])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    w = ahead = np.zeros(rows.shape[1])
    rate, pace = 1.0 / (1.0 + 2 * cost * 2.0), 1.0
    for _ in range(steps):
        slack = np.maximum(0.0, 1.0 - y * (rows @ ahead.astype(np.float32)))
        gradient = ahead - 2 * cost * ((weight * y * slack).astype(np.float32) @ rows)
        after = ahead - rate * gradient
        faster = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        ahead, w, pace = after + (pace - 1) / faster * (after - w), after, faster
    return w


@dataclass
class Hierarchy:
    """Families with their languages, a machine per family, and a machine per pair of a family's languages."""

    families: list[list[str]]
    roots: np.ndarray | None = None
    pairs: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)

    @classmethod
    def train(cls, x: np.ndarray, langs: list[str]) -> Hierarchy:
        groups: dict[str, list[str]] = {}
        for lang in sorted(set(langs)):
            groups.setdefault(_FAMILY.get(lang, f"only {lang}"), []).append(lang)
        found, of = cls(list(groups.values())), np.array(langs, object)
        if len(found.families) > 1:
            found.roots = np.stack([machine(x, np.where(np.isin(of, list(family)), 1.0, -1.0)) for family in found.families])
        for family in found.families:
            for i, a in enumerate(family):
                for b in family[i + 1 :]:
                    both = (of == a) | (of == b)
                    found.pairs[a, b] = machine(x[both], np.where(of[both] == a, 1.0, -1.0))
        return found

    def predict(self, vector: np.ndarray) -> tuple[str, float]:
        """Language and score of one vector; ties go to the earlier family and language."""
        row, score, family = np.append(vector, 1.0), 1.0, self.families[0]
        if self.roots is not None:
            margins = self.roots @ row
            best = int(np.argmax(margins))
            score, family = _logistic(margins[best] - np.delete(margins, best).max()), self.families[best]
        votes = dict.fromkeys(family, 0)
        sure = dict.fromkeys(family, 1.0)
        for i, a in enumerate(family):
            for b in family[i + 1 :]:
                margin = float(self.pairs[a, b] @ row)
                votes[a if margin >= 0 else b] += 1
                sure[a], sure[b] = min(sure[a], _logistic(2 * margin)), min(sure[b], _logistic(-2 * margin))
        best = max(family, key=lambda lang: (votes[lang], sure[lang]))
        return best, float(score * sure[best])


def _logistic(margin: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(2 * margin, -60, 60))))


@F.arrow_udf(T.BinaryType())
def _profiles(text: pa.Array) -> pa.Array:
    return pa.array([profile(t).tobytes() for t in utf8(text)], pa.binary())


def learn(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    per_language: int = PER_LANGUAGE, in_all: int = IN_ALL,
) -> Hierarchy | None:
    """Train on rows that are not held out and have a language; None if there are none.

    Rows enter the sample by a hash of id and text, about ``per_language`` of
    each language and ``in_all`` in all, so its size does not grow with the table.
    """
    known = docs.where((remainder(F.col(id_col), 3) != 1) & F.col(lang_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")
    )
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    each = min(per_language, max(2, in_all // len(sizes)))
    part = F.lit(0.0)
    for lang, n in sizes.items():
        part = F.when(F.col("lang") == lang, F.lit(min(1.0, each / n))).otherwise(part)
    chance = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) / float(1 << 30)
    # the bound of the sample holds even where one row is repeated many times
    rows = known.where(chance < part).select("lang", _profiles("text").alias("profile")).limit(2 * in_all).collect()
    rows = rows or known.limit(in_all).select("lang", _profiles("text").alias("profile")).collect()
    rows.sort(key=lambda r: (r["lang"], bytes(r["profile"])))
    return Hierarchy.train(np.stack([np.frombuffer(r["profile"], np.float32) for r in rows]), [r["lang"] for r in rows])


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **sample) -> DataFrame:
    """Language of every whole text: one row per input row with ``id_col``, held_out, lang_pred, score.

    * Texts teach only where crc32(id) mod 3 is not 1 and ``lang_col`` is not null.
    * Null texts and texts without a letter are ``und`` with score 0, and so is
      every text if nothing could be learned.
    * An empty table gives an empty result; other columns take no part.
    """
    model = learn(docs, id_col, text_col, lang_col, **sample)

    @F.arrow_udf(T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())]))
    def judge(text: pa.Array) -> pa.Array:
        found = [model.predict(profile(t)) if model and has_letter(t) else ("und", 0.0) for t in utf8(text)]
        langs, scores = zip(*found, strict=True) if found else ((), ())
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    held = (remainder(F.col(id_col), 3) == 1).alias("held_out")
    judged = docs.select(F.col(id_col).alias(id_col), held, judge(F.col(text_col)).alias("judged"))
    return judged.select(id_col, "held_out", F.col("judged")["lang"].alias("lang_pred"), F.col("judged")["score"].alias("score"))
