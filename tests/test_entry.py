"""The entry module with and without the optional subpackage, in a copy of the repository and a process of its own."""

import os
import shutil
import subprocess
import sys

import pytest

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
NAMES = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(sum(n.startswith('op') and n[2].isdigit() for n in q), 'pipeline' in q, len(q) > 40)"


@pytest.mark.parametrize("drop", [("strandix/llm", "tests/llm"), ("strandix/llm", "tests/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_entry_without_the_subpackage(tmp_path, drop):
    copy = tmp_path / "copy"
    shutil.copytree(HERE, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.json", "*.md"))
    for name in drop:
        if (copy / name).is_dir():
            shutil.rmtree(copy / name)
        elif (copy / name).exists():
            (copy / name).unlink()
    there = (copy / "strandix/llm/registry.py").exists()
    out = subprocess.run([sys.executable, "-c", NAMES], cwd=copy, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    assert out.stdout.split() == ["13" if there else "0", "False", "True"]
