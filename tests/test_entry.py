"""The repository without its training-data parts."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
PROBE = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 25 and set(o) <= set(q) and not any(k.startswith('op') and k[2].isdigit() for k in q) and 'pipeline' not in q"


@pytest.mark.parametrize("gone", [("weftline/llm", "tests/llm"), ("weftline/llm", "tests/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_queries_without_training_data_parts(tmp_path, gone):
    tree = tmp_path / "tree"
    shutil.copytree(ROOT, tree, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", *[g.rpartition("/")[2] for g in gone]))
    assert not any((tree / g).exists() for g in gone)
    probe = PROBE if "weftline/llm" in gone else PROBE.partition(" and not any")[0] + " and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", probe], cwd=tree, env={"PATH": "/usr/bin", "PYTHONPATH": str(tree)}, check=True, timeout=120)
