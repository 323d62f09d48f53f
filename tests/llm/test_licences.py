from samples import docs, empty

from relaygrid.llm.licences import KNOWN, scan_licences

MIT, NOTICE = KNOWN[0][1], "Released under the MIT License."


def scan(spark, *texts):
    rows = scan_licences(docs(spark, [(i, t, None, None) for i, t in enumerate(texts)])).collect()
    return {r["doc_id"]: (r["licence"], list(r["notices"])) for r in rows}


def test_whole_texts(spark):
    spelled = "Copyright (c) 1999 Someone\nAll rights reserved.\n\n" + MIT.upper().replace("NONINFRINGEMENT", "non-infringement").replace("COPYRIGHT HOLDERS", "copyright owners")
    found = scan(spark, MIT, spelled, MIT + " And more.", "MIT License\n\n© 2020 me\n" + MIT, NOTICE, "RELEASED -- under the mit licence")
    assert [found[i][0] for i in range(6)] == ["MIT", "MIT", None, "MIT", "MIT", "MIT"]


def test_notices_in_longer_texts(spark):
    text = f"Some prose.\n  {NOTICE.upper()}  \nMore prose.\nLicensed under CC BY-NC 4.0.\n{NOTICE}"
    assert scan(spark, text, f"In one line: {NOTICE}") == {0: (None, ["CC-BY-NC-4.0", "MIT"]), 1: (None, [])}


def test_odd_rows(spark):
    found = scan(spark, None, "", " ...! ", "Copyright 2020 by me", "x " * 50_000)
    assert all(v == (None, []) for v in found.values())
    rows = {r["doc_id"]: r["digest"] for r in scan_licences(docs(spark, [(0, None, "", ""), (1, "", "", ""), (2, "--", "", "")])).collect()}
    assert rows == {0: None, 1: None, 2: None}
    assert scan_licences(empty(spark)).count() == 0
    assert scan_licences(docs(spark)).count() == docs(spark).count()
