"""The driver's contract, also without the subpackage of training-data operators."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

import pytest
from conftest import ROOT

import __spark_entry__ as entry


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.count() == 10
    assert rows.columns[0] == "gene_id"


def test_names():
    names, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(names)
    assert len(names) > 100


@pytest.mark.parametrize("pipeline", [False, True])
def test_without_the_subpackage(tmp_path, pipeline):
    """All but the training-data operators, their tests and, or not, their pipeline: the rest imports, and its tests are found and run."""
    left_out = shutil.ignore_patterns("llm", ".git", "__pycache__", ".pytest_cache", *([] if pipeline else ["corpus_pipeline.py"]))
    shutil.copytree(ROOT, f"{tmp_path}/repo", ignore=left_out)
    code = "import __spark_entry__ as e; n = e.queries(); assert len(n) > 100 and not any(x.startswith('op1') for x in n) and 'pipeline' not in n; assert set(e.oracle_sql()) <= set(n)"
    env = os.environ | {"PYTHONPATH": f"{tmp_path}/repo"}

    def run(*args):
        return subprocess.run([sys.executable, *args], cwd=f"{tmp_path}/repo", env=env, capture_output=True, text=True)

    assert (out := run("-c", code)).returncode == 0, out.stderr
    assert (out := run("-m", "pytest", "--collect-only", "-q", "tests")).returncode == 0, out.stdout
    if not pipeline:
        assert (out := run("-m", "pytest", "-q", "-x", "tests/test_sources.py", "-k", "literals or gtf")).returncode == 0, out.stdout
