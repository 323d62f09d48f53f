import math
import zlib

import numpy as np
from pyspark.sql import functions as F
from samples import docs, empty, rows

from relaygrid.llm import language, quality
from relaygrid.llm.common import read

SF = "/root/testdata/sf0.01"


def held(i, modulus=3, rest=1):
    return zlib.crc32(("" if i is None else str(i)).encode()) % modulus == rest


def test_quality_on_held_out_rows(spark):
    labels = read(spark, SF, "labels")
    found = quality.quality(read(spark, SF, "documents"), labels)
    assert all(r["held_out"] == held(r["doc_id"]) and r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in found.collect())
    judged = found.join(labels, "doc_id").where("held_out").select((F.col("quality") == F.col("predicted")).cast("int").alias("right"))
    assert judged.agg(F.avg("right")).first()[0] > 0.97


def test_discriminant_is_the_gaussian_log_density_difference(spark):
    """Scores against densities computed straight from their definition."""
    labels = read(spark, SF, "labels").limit(200)
    rows_ = read(spark, SF, "documents").join(labels, "doc_id").select("text", "quality", "doc_id").collect()
    x = np.array([quality.describe(r["text"].encode()) for r in rows_])
    y = np.array([r["quality"] for r in rows_])
    teach = np.array([not held(r["doc_id"]) for r in rows_])
    cov = {k: np.cov(x[teach & (y == k)].T, bias=True) for k in (0, 1)}
    n = {k: int((teach & (y == k)).sum()) for k in (0, 1)}
    pooled = np.diag(np.maximum((n[0] * np.diag(cov[0]) + n[1] * np.diag(cov[1])) / (n[0] + n[1]), 1e-6))
    logs = {}
    for k in (0, 1):
        s = (1 - quality.SHRINKAGE) * cov[k] + quality.SHRINKAGE * pooled
        d = x - x[teach & (y == k)].mean(axis=0)
        logs[k] = -0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d) - 0.5 * np.linalg.slogdet(s)[1] + math.log(n[k])
    want = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))
    frame = read(spark, SF, "documents").join(labels.select("doc_id"), "doc_id")
    found = {r["doc_id"]: r["score"] for r in quality.quality(frame, labels).collect()}
    assert np.allclose([found[r["doc_id"]] for r in rows_], want, atol=1e-6)


def test_quality_of_odd_rows(spark):
    labels = read(spark, SF, "labels")
    none = quality.quality(docs(spark), labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5} and len(none) == len(rows())
    odd = spark.createDataFrame([(1, 1, "x"), (1, None, "x"), (None, 0, "x"), (5, 7, "x")], "doc_id long, quality int, features string")
    assert quality.quality(docs(spark), odd).count() == len(rows())
    assert quality.quality(empty(spark), labels).count() == 0
    assert quality.keep_good(empty(spark), labels).count() == 0
    both = read(spark, SF, "documents").unionByName(docs(spark), allowMissingColumns=True)
    scores = {r["doc_id"]: r["score"] for r in quality.quality(both.withColumn("doc_id", F.col("doc_id") + 10**6 * F.col("row").isNotNull().cast("int")), labels).collect()}
    assert all(scores[10**6 + i] > 0.5 for i in (2, 3, 4)) and len(scores) > 1000  # texts without words look typical
    kept = quality.keep_good(read(spark, SF, "documents"), labels)
    assert kept.columns == read(spark, SF, "documents").columns and 800 < kept.count() < 950


def test_language_on_held_out_rows(spark):
    frame = read(spark, SF, "documents")
    found = language.identify(frame)
    assert all(r["held_out"] == held(r["doc_id"]) and 0 <= r["score"] <= 1 for r in found.collect())
    right = found.join(frame, "doc_id").where("held_out").select((F.col("lang") == F.col("lang_pred")).cast("int").alias("right"))
    assert right.agg(F.avg("right")).first()[0] > 0.98
    # ids, sources and languages of the judged row play no part
    blind = frame.withColumns({"source": F.lit(None).cast("string"), "lang": F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1, F.col("lang"))})
    assert sorted(map(tuple, language.identify(blind).collect())) == sorted(map(tuple, found.collect()))


def test_language_of_odd_rows(spark):
    found = sorted([tuple(r) for r in language.identify(docs(spark)).collect()], key=repr)
    assert len(found) == len(rows())
    pred = {f[0]: f[2] for f in found}
    assert all(pred[i] == "und" for i in (2, 3, 4, 11)) and pred[1] == "en" and pred[10] in ("de", "en")
    nothing = language.identify(docs(spark).withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r["lang_pred"], r["score"]) for r in nothing} == {("und", 0.0)}
    single = language.identify(docs(spark).withColumn("lang", F.lit("xx"))).collect()
    assert {r["lang_pred"] for r in single} == {"xx", "und"}
    assert language.identify(empty(spark)).count() == 0
    assert language.has_letter("é".encode()) and language.has_letter(b"1" * 100 + b"x") and not language.has_letter("１２ ·".encode())


def test_machine_separates():
    draw = np.random.default_rng(0)
    x = draw.normal(size=(400, 5)).astype(np.float32)
    y = np.where(x @ np.array([1, -2, 0.5, 0, 1]) > 0, 1.0, -1.0)
    w = language.machine(x, y)
    assert (np.sign(np.hstack([x, np.ones((400, 1))]) @ w) == y).mean() > 0.97
