"""URL filter: domain rules, and a classifier for what no rule covers.

A host without a rule is split into words by a unigram model (Viterbi), whose
word counts come from the pages themselves, host names in them apart; a
multinomial naive Bayes over the host's words and the path's tokens then decides.  Its classes are taught by the
pages: those whose host words hold a listed term teach ``block``, the others
``allow``; listed terms have a share of class ``block`` beforehand.  Both classes are smoothed by the typical page, so tokens common to all say
little.

Hosts are segmented once each.  A host meets the counts of its own substrings
by a join, so the table of words is never gathered or broadcast.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relaygrid.session import config_table, settle

#: (host, path, verdict) as given; a rule's text is host and path.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Terms that mark hosts nobody wants in training text.
TERMS = (
    "adult", "porn", "xxx", "sex", "escort", "casino", "gambling", "betting", "bet", "bets", "poker", "viagra", "pharma", "pills", "spam",
    "phishing", "malware", "warez", "torrent", "crack", "ads", "adserver", "popup", "tracker", "clickbait",
)
#: Share of the listed terms among the tokens of class ``block``, and the tokens of typical pages that both classes count beside their own.
TERM_SHARE, TYPICAL = 0.2, 20.0
#: What a listed term counts among the words of the segmentation.
TERM_COUNT = 1000
#: Share of ``block`` before a url is read.
PRIOR = 0.2
#: Longest word of a segmentation; a word not seen costs as if seen once in ten times the text, and ten times more per letter.
LONGEST, UNSEEN, PER_LETTER = 20, 10.0, 10.0

#: Labels joined by dots; not two sentences without a space ("end.Next").  Looked for at a label's start only, so in one pass.
NAMES = r"(?<![\p{L}\p{N}-])[\p{L}\p{N}-]++(?:\.(?!(?<=\p{Ll}\.)\p{Lu})[\p{L}\p{N}-]++)+"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fold(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return fold(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits the host, or a domain above it, and the path's start; else null."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, start, says in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):  # the longest last, so it stands outermost
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(start))
        rule, verdict = F.when(fits, F.lit(name + start)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def segment(name: str, counts: dict[str, int], total: int) -> list[str]:
    """The likeliest split of ``name`` into words under their counts; of equal ones the one whose last words are longest."""
    scale = math.log(total + 1.0)
    best = [0.0] + [-math.inf] * len(name)
    back = [0] * (len(name) + 1)
    for end in range(1, len(name) + 1):
        for start in range(max(0, end - LONGEST), end):
            word = name[start:end]
            seen = counts.get(word, 0)
            cost = math.log(seen) - scale if seen else -scale - math.log(UNSEEN) - (end - start) * math.log(PER_LETTER)
            if best[start] + cost > best[end]:
                best[end], back[end] = best[start] + cost, start
    words, end = [], len(name)
    while end:
        words.append(name[back[end] : end])
        end = back[end]
    return words[::-1]


def labels_of(host: Column) -> Column:
    """Runs of letters and digits in the host, the top-level domain apart."""
    names = F.regexp_replace(host, r"(:[0-9]*$)|(\.[^.]*$)", "")
    return F.filter(F.split(names, r"[^\p{L}\p{N}]+"), lambda x: x != "")


def path_tokens(path: Column) -> Column:
    """Letter runs of the path, lower-cased: numbers tell pages apart, not kinds of pages."""
    return F.filter(F.split(fold(path), r"[^\p{L}]+"), lambda x: x != "")


def word_counts(texts: Column, hosts: Column, pages: DataFrame, terms: tuple[str, ...]) -> DataFrame:
    """word, n: letter runs of the pages' texts, and the terms.

    Names are no evidence that they are words: host names in a text do not
    count, nor do on a page the letter runs of its own host.
    """
    apart = r"[^\p{L}]+"
    named = pages.select(F.split(F.lower(hosts), apart).alias("own"), F.explode(F.split(F.lower(F.regexp_replace(texts, NAMES, " ")), apart)).alias("word"))
    words = named.where((F.col("word") != "") & (F.length("word") <= LONGEST) & ~F.array_contains("own", F.col("word")))
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    kind = T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])
    own = config_table(pages.sparkSession, [(t, TERM_COUNT) for t in terms], kind)
    return counted.unionByName(own).groupBy("word").agg(F.sum("n").alias("n"))


def segmented(hosts: DataFrame, counts: DataFrame) -> DataFrame:
    """host, words: every distinct host, its labels split into words."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    names = settle(hosts.select(F.explode(labels_of(F.col("host"))).alias("name")).distinct(), "url-names")
    starts = names.select("name", F.explode(F.sequence(F.lit(1), F.length("name"))).alias("start"))
    spans = starts.select("name", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.length("name") - F.col("start") + 1))).alias("size"))
    pieces = spans.select("name", F.expr("substring(name, start, size)").alias("word")).distinct()
    seen = pieces.join(counts, "word").groupBy("name").agg(F.collect_list(F.struct("word", "n")).alias("seen"))

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def split(name: pa.Array, found: pa.Array) -> pa.Array:
        rows = zip(name.to_pylist(), found.to_pylist(), strict=True)
        return pa.array([segment(text, {w["word"]: w["n"] for w in words or ()}, total) for text, words in rows], pa.list_(pa.string()))

    words = settle(names.join(seen, "name", "left").select("name", split("name", "seen").alias("words")), "url-words")
    parts = hosts.select("host", F.posexplode(labels_of(F.col("host"))).alias("place", "name"))
    joined = parts.join(words, "name").groupBy("host").agg(F.sort_array(F.collect_list(F.struct("place", "words"))).alias("parts"))
    full = hosts.join(joined, "host", "left")
    none = F.array().cast("array<string>")
    return full.select("host", F.coalesce(F.flatten(F.col("parts")["words"]), none).alias("words"))


def judge_urls(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html",
    rules: tuple[tuple[str, str, str], ...] = RULES, terms: tuple[str, ...] = TERMS,
) -> DataFrame:
    """Verdict of every url: one row per input row with ``id_col``, host, path, rule, verdict, words, odds.

    * Null urls and urls without ``://`` have an empty host and path, fit no
      rule and, without any token, follow ``PRIOR``: they are allowed.
    * A rule fits its host and all subdomains if the path starts with the
      rule's; the longest rule wins, of equal ones the last in order.
    * ``words``: the host's words; ``odds``: natural log of how much likelier
      ``block`` is.  Where no rule fits, odds over 0 block.
    * Repeated rows are judged alike; an empty table gives an empty result;
      other columns take no part.
    """
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = settle(rows.withColumns({"rule": rule, "ruled": verdict}), "url-rows")
    # whatever is judged by host and path alone is judged once for all pages that share them
    tokens = path_tokens(F.col("path"))
    kinds = settle(rows.select("host", tokens.alias("tokens")).groupBy("host", "tokens").agg(F.count(F.lit(1)).alias("n")), "url-kinds")
    visible = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), "<[^>]*>", " ")
    counts = settle(word_counts(visible, host_of(url), pages, terms), "url-counts")
    split = settle(segmented(kinds.select("host").distinct(), counts), "url-hosts")
    listed = F.exists("words", lambda w: w.isin(*terms))
    taught = kinds.join(split, "host").select(
        "host", "tokens", "n", "words", listed.alias("bad"), F.concat(F.transform("words", lambda w: F.concat(F.lit("h:"), w)), F.transform("tokens", lambda t: F.concat(F.lit("p:"), t))).alias("features"),
    )
    taught = settle(taught, "url-taught")
    seen = taught.select(F.explode("features").alias("feature"), "bad", "n").groupBy("feature").agg(
        F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("bad"), 0).otherwise(F.col("n"))).alias("good")
    )
    seen = settle(seen, "url-features")
    total = seen.agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.count(F.lit(1)).alias("v")).first()
    bad, good, kinds_of = float(total["bad"] or 0), float(total["good"] or 0), float(total["v"])
    # typical pages are smoothed by one for every feature, so what is common everywhere says little
    typical = F.lit(TYPICAL) * (F.col("bad") + F.col("good") + 1) / F.lit(bad + good + kinds_of)
    own = F.when(F.col("feature").isin(*[f"h:{t}" for t in terms]), F.lit(TERM_SHARE / len(terms))).otherwise(0.0)
    blocked = (F.col("bad") + typical) / F.lit(bad + TYPICAL) * F.lit(1 - TERM_SHARE) + own
    weight = F.log(blocked) - F.log((F.col("good") + typical) / F.lit(good + TYPICAL))
    weighed = seen.select("feature", weight.alias("weight"))
    each = taught.select("host", "tokens", F.explode("features").alias("feature"))
    sums = each.join(weighed, "feature").groupBy("host", "tokens").agg(F.sum("weight").alias("weight"))
    odds = (F.coalesce("weight", F.lit(0.0)) + F.lit(math.log(PRIOR / (1 - PRIOR)))).alias("odds")
    judged = settle(taught.select("host", "tokens", "words").join(sums, ["host", "tokens"], "left").select("host", "tokens", "words", odds), "url-judged")
    found = rows.withColumn("tokens", tokens).join(judged, ["host", "tokens"])
    own_verdict = F.when(F.col("odds") > 0, "block").otherwise("allow")
    return found.select(
        F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", own_verdict).alias("verdict"), "words", "odds"
    )
