"""The driver contract, with and without the optional parts."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__

REPO = Path(__spark_entry__.__file__).parent


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("gone", [["lattiq/llm", "tests/llm", "corpus_pipeline.py"], ["lattiq/llm", "tests/llm"]])
def test_the_rest_stands_without_the_text_operators(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", *[Path(g).name for g in gone if g != "tests/llm"]))
    shutil.rmtree(copy / "tests/llm", ignore_errors=True)
    code = "import __spark_entry__ as e, bench; q = e.queries(); e.oracle_sql(); assert len(q) > 40 and not any(k.startswith('op') or k == 'pipeline' for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, timeout=120)
