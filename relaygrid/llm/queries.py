"""The registered queries of the text operators: each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relaygrid.llm import ann, exact_dedup, fingerprints, language, licences, lm_score, merkle, mixing, near_dedup, packing, quality, urls, whitening
from relaygrid.llm.common import read, remainder
from relaygrid.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None):
    """Register ``fn(spark, sf_dir)``; ``check`` is the equivalent SQL."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(tune(spark), sf_dir)

        QUERIES[name] = run
        if check is not None:
            CHECKS[name] = check
        return fn

    return register


@query("op1_packing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


@query("op2_urls")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.judge_urls(read(spark, sf_dir, "pages"))
    return judged.select("page_id", "host", "path", "rule", "verdict", F.array_join("words", " ").alias("words"))


@query("op3_nearest")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def _licence_sql() -> str:
    """The licence scan over documents, with the known texts as rows."""

    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    def respelled(form: str) -> str:
        out = f"' ' || trim({form}) || ' '"
        for spelled, other in licences.SPELLINGS:
            out = f"replace({out}, ' {spelled} ', ' {other} ')"
        return f"trim({out})"

    def hashed(form: str) -> str:
        return f"sha256(nullif({form}, ''))"

    def bare(text: str) -> str:
        low = f"regexp_replace(lower(coalesce({text}, '')), {quoted(licences.COPYRIGHT_LINE)}, '', 'g')"
        return f"regexp_replace({low}, {quoted(licences.MARKS)}, ' ', 'g')"

    flat = respelled(r"regexp_replace(bare, '[ \n]+', ' ', 'g')")
    rows = ", ".join(f"({quoted(name)}, {quoted(body)})" for name, body in licences.KNOWN)
    return f"""
    WITH known AS (
        SELECT {hashed(flat)} AS digest, licence FROM (SELECT licence, {bare("body")} AS bare FROM (VALUES {rows}) AS t(licence, body))
    ), named AS (SELECT digest, min(licence) AS licence FROM known GROUP BY digest),
    docs AS (SELECT row_number() OVER () AS r, doc_id, {bare("text")} AS bare FROM documents),
    lines AS (SELECT r, unnest(string_split(bare, chr(10))) AS line FROM docs),
    noted AS (
        SELECT r, string_agg(DISTINCT licence, ',' ORDER BY licence) AS notices
        FROM (SELECT r, {hashed(respelled("line"))} AS digest FROM lines) JOIN known USING (digest) GROUP BY r
    )
    SELECT doc_id, d.digest, n.licence, coalesce(x.notices, '') AS notices
    FROM (SELECT r, doc_id, {hashed(flat)} AS digest FROM docs) d
    LEFT JOIN named n ON d.digest = n.digest LEFT JOIN noted x ON d.r = x.r
    """


@query("op4_licences", _licence_sql())
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan_licences(read(spark, sf_dir, "documents"))
    return found.withColumn("notices", F.array_join("notices", ","))


@query("op5_quality")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query("op6_language")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(read(spark, sf_dir, "documents"))


@query("op7_near_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(read(spark, sf_dir, "documents"), size=2)


@query("op8_mixing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents"))
    taken = F.aggregate("spans", F.lit(0).cast("long"), lambda total, span: total + span["words"])
    return mixed.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


@query("op9_exact_dedup", r"""
    WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
    g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
    SELECT doc_id, keep_id, group_size,
           coalesce(doc_id = keep_id, keep_id IS NULL) AND row_number() OVER (PARTITION BY doc_id, norm) = 1 AS kept,
           sha256(norm) AS text_sha256
    FROM d JOIN g USING (norm)
""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents"))


@query("op10_lm_score")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.lm_score(read(spark, sf_dir, "documents"))


def _merkle_sql(levels: int = 6, fan: int = 16) -> str:
    """Manifest and proofs level by level; ``levels`` is enough for fan ** levels leaves a source."""
    fields = [f"coalesce(octet_length(encode(CAST({f} AS VARCHAR))) || ':' || CAST({f} AS VARCHAR), '-')" for f in merkle.FIELDS]
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    claimed = [f.replace("CAST(text AS VARCHAR)", lowered) for f in fields]
    step = "list_reduce(list_concat([xor(crc, byte)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, bit: xor(c >> 1, 3988292384 * (c & 1)))"
    digits = "list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''), lambda d: CAST(ascii(d) AS BIGINT))"
    crc = f"xor(list_reduce(list_concat([4294967295], list_filter({digits}, lambda d: d > 0)), lambda crc, byte: {step}), 4294967295)"
    views = [f"""d AS (
        SELECT doc_id, source, sha256({" || ".join(fields)}) AS leaf,
               CASE WHEN {crc} % 5 = 0 THEN sha256({" || ".join(claimed)}) END AS claim
        FROM documents)""", """b0 AS (
        SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
               row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
               coalesce(claim, leaf) AS held, '' AS proof, leaf AS node
        FROM d)"""]

    def climb(name: str, tree: str) -> None:
        """Each view: the leaves with their node, their place, the proof so far and the digest folded so far."""
        run = f"PARTITION BY t, pos // {fan}"
        left = f"string_agg(node, '' ORDER BY pos) OVER ({run} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        right = f"string_agg(node, '' ORDER BY pos) OVER ({run} ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"
        for k in range(levels):
            views.append(f"""{name}n{k} AS (
                SELECT {tree} AS t, pos, node, count(*) OVER (PARTITION BY {tree}) AS n FROM (SELECT DISTINCT {tree}, pos, node FROM {name}{k}))""")
            views.append(f"""{name}r{k} AS (
                SELECT *, CASE WHEN n = 1 THEN node ELSE sha256(string_agg(node, '' ORDER BY pos) OVER ({run})) END AS above,
                    CASE WHEN n = 1 THEN '' ELSE coalesce({left}, '') END AS l, CASE WHEN n = 1 THEN '' ELSE coalesce({right}, '') END AS r
                FROM {name}n{k})""")
            views.append(f"""{name}{k + 1} AS (
                SELECT x.* EXCLUDE (pos, held, proof, node), CASE WHEN n = 1 THEN x.pos ELSE x.pos // {fan} END AS pos,
                    CASE WHEN n = 1 THEN held ELSE sha256(l || held || r) END AS held, proof || l || r AS proof, above AS node
                FROM {name}{k} x JOIN {name}r{k} y ON {tree} = y.t AND x.pos = y.pos)""")

    climb("b", "tree")
    views.append(f"u0 AS (SELECT * EXCLUDE (pos, tree), node AS subroot, tree AS pos, 0 AS tree FROM b{levels})")
    climb("u", "tree")
    return "WITH " + ",\n".join(views) + f"""
    SELECT doc_id, leaf, subroot, node AS root, sha256(proof) AS proof_sha256, held AS folded_root, held = node AS verified FROM u{levels}
    """


@query("op11_merkle", _merkle_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.check_tampered(read(spark, sf_dir, "documents"), remainder(F.col("doc_id"), 5) == 0)


@query("op12_fingerprints")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(read(spark, sf_dir, "documents"))


@query("op13_whitening")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def checks() -> dict[str, str]:
    return dict(CHECKS)
