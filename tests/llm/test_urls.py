import math
import re

import pytest
from pyspark.sql import functions as F

from relaygrid.llm import urls

KIND = "page_id long, url string, html string, id string, host string, words string, tokens string, rule string"
PAGES = [
    (1, "https://www.Example.NET/en/1?x=/de/"), (2, "http://example.net"), (3, "http://badexample.net/en/"), (4, "ftp://a.example.com/de/x#y"), (5, None), (6, "no scheme/de/"),
    (7, "https://cheapcasinopills.example.com/fr/9"), (8, "https://blog.stoneriver.example.org/fr/2"), (8, "https://blog.stoneriver.example.org/fr/2"), (9, "x://y://example.net/en/"),
    (10, "https://stoneriver.example.com?q=http://spam.net/"), (11, "https://" + "stone" * 300 + ".com/" + "a" * 5000), (12, "://"), (13, "https:///path"), (14, "https://example.org:80/fr/\nx"),
]


def pages(spark, rows=PAGES):
    html = "<p>stone river cheap walks under stone river</p>"
    return spark.createDataFrame([(i, u, html, "x", "x", "x", "x", "x") for i, u in rows], KIND)


def plain(url):
    place = (url or "").find("://")
    if place < 0:
        return "", "", None, None
    rest = url[place + 3 :]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(n + p, v) for n, p, v in urls.RULES if (host == n or host.endswith("." + n)) and path.startswith(p)]
    return host, path, *(max(fits, key=lambda f: len(f[0])) if fits else (None, None))


def test_hosts_paths_and_rules(spark):
    found = sorted([(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge_urls(pages(spark)).collect()], key=repr)
    assert len(found) == len(PAGES)
    want = sorted([(i, *plain(u)) for i, u in PAGES], key=repr)
    assert [f[:4] for f in found] == [w[:4] for w in want]
    assert all(f[4] in ("allow", "block") and w[4] in (None, f[4]) for f, w in zip(found, want, strict=True))


def test_method(spark):
    found = {r["page_id"]: r for r in urls.judge_urls(pages(spark)).collect()}
    assert list(found[7]["words"]) == ["cheap", "casino", "pills", "example"] and found[7]["verdict"] == "block"
    assert list(found[10]["words"]) == ["stone", "river", "example"] and found[10]["verdict"] == "allow"
    assert found[5]["verdict"] == found[6]["verdict"] == "allow" and found[5]["odds"] == pytest.approx(math.log(0.25))
    assert urls.judge_urls(pages(spark, [])).count() == 0


def test_names_in_the_texts_are_no_words(spark):
    """Pages print their own host, others link to it: the name is still split."""
    own = "<p>cheap walks. Sky.Then</p><footer>(c) cheapcasinopills.example.com - CheapCasinoPills, http://stoneriver.example.org/x and stoneriver.net</footer>"
    rows = [(i, f"https://cheapcasinopills.example.com/fr/{i}", own) for i in range(200)]
    rows += [(1000 + i, f"https://stoneriver.example.com/{i}", "<p>stone river: see cheapcasinopills.example.com</p>stoneriver") for i in range(200)]
    frame = spark.createDataFrame([(i, u, h, "x", "x", "x", "x", "x") for i, u, h in rows], KIND)
    found = {(r["host"], tuple(r["words"]), r["verdict"]) for r in urls.judge_urls(frame).collect()}
    assert found == {
        ("cheapcasinopills.example.com", ("cheap", "casino", "pills", "example"), "block"), ("stoneriver.example.com", ("stone", "river", "example"), "allow"),
    }
    counts = {r["word"]: r["n"] for r in urls.word_counts(F.regexp_replace("html", "<[^>]*>", " "), urls.host_of(F.col("url")), frame, ("spam",)).collect()}
    assert counts["sky"] == counts["then"] == counts["cheap"] == counts["stone"] == 200
    assert not {"cheapcasinopills", "stoneriver", "example"} & set(counts)


@pytest.mark.parametrize("name", ["therein", "aab", "zzz", "a", "inthere"])
def test_segmentation_is_the_likeliest(name):
    counts, total = {"the": 50, "there": 20, "in": 60, "rein": 5, "a": 30, "ab": 9, "here": 30}, 204

    def cost(word):
        seen = counts.get(word)
        return math.log(seen / 205) if seen else -math.log(205) - math.log(urls.UNSEEN) - len(word) * math.log(urls.PER_LETTER)

    def splits(text):
        yield [text]
        for i in range(1, len(text)):
            for rest in splits(text[i:]):
                yield [text[:i], *rest]

    best = max(sum(map(cost, s)) for s in splits(name))
    assert sum(map(cost, urls.segment(name, counts, total))) == pytest.approx(best)


def test_blocked_terms_in_the_given_pages(spark):
    from relaygrid.llm.common import read

    found = urls.judge_urls(read(spark, "/root/testdata/sf0.01", "pages")).where("rule is null").collect()
    for r in found:
        assert (r["verdict"] == "block") == bool(re.search("adult|casino|pills|spam|bets|ads", r["host"])), r["host"]
