"""Run the text queries against their SQL: python tests/llm/oracle_llm.py [sf] [name ...]"""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

sys.path[:0] = [str(Path(__file__).resolve().parents[2]), str(Path(__file__).resolve().parents[1])]

from oracle import _plain, connect  # noqa: E402
from relaygrid.llm import queries as llm  # noqa: E402
from relaygrid.session import local_session  # noqa: E402


def differences(spark, sf_dir: str, name: str):
    df = llm.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    mine = Counter(tuple(_plain(v) for v in row) for row in df.select(*columns).collect())
    result = connect(sf_dir).execute(llm.checks()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns, (columns, names)
    order = [names.index(c) for c in columns]
    theirs = Counter(tuple(_plain(row[i]) for i in order) for row in result.fetchall())
    return list((mine - theirs).items())[:3], list((theirs - mine).items())[:3], sum(mine.values())


if __name__ == "__main__":
    folder = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
    session = local_session("8")
    for query_name in sys.argv[2:] or llm.checks():
        began = time.time()
        print(query_name, *differences(session, folder, query_name), f"{time.time() - began:.1f} s", flush=True)
