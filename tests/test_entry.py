"""The entry module with and without the optional text operators."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).parents[1]
LIST = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries(), any(n.startswith('op') for n in e.queries()))"


@pytest.mark.parametrize("with_pipeline", [True, False])
def test_without_text_operators(tmp_path, with_pipeline):
    """The driver deletes the text operators, and maybe the pipeline; all other queries stay."""
    copy = tmp_path / "repo"
    left_out = shutil.ignore_patterns("llm", "__pycache__", ".git", *([] if with_pipeline else ["corpus_pipeline.py"]))
    shutil.copytree(ROOT, copy, ignore=left_out)
    env = {**os.environ, "PYTHONPATH": str(copy)}
    shown = subprocess.run([sys.executable, "-c", LIST], cwd=copy, env=env, capture_output=True, text=True, check=True, timeout=120)
    queries, checks, pipeline, texts = shown.stdout.split()
    assert int(queries) > 100
    assert int(checks) == int(queries)
    assert (pipeline, texts) == ("False", "False")
