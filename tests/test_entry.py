"""The entry point without its optional parts."""

import os
import shutil
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = """
import __spark_entry__ as e
q, o = e.queries(), e.oracle_sql()
assert "library_summary" in q and set(o) <= set(q), sorted(q)
print(len([k for k in q if k.startswith("op") and k[2].isdigit()]), "pipeline" in q)
"""


def checkout(tmp_path, *without):
    """A copy of the code without some paths."""
    skip = shutil.ignore_patterns("__pycache__", ".git", "*.json")
    shutil.copytree(REPO, tmp_path / "repo", ignore=lambda d, names: {
        n for n in names if os.path.relpath(os.path.join(d, n), REPO) in without} | set(skip(d, names)))
    return tmp_path / "repo"


def run(where):
    return subprocess.run([sys.executable, "-c", SCRIPT], cwd=where, capture_output=True, text=True, timeout=120,
                          env={**os.environ, "PYTHONPATH": str(where)})


@pytest.mark.parametrize("without", [
    ("promptspark/llm", "tests/llm", "corpus_pipeline.py"), ("promptspark/llm", "tests/llm"), ("corpus_pipeline.py",)])
def test_parts_left_out(tmp_path, without):
    got = run(checkout(tmp_path, *without))
    assert got.returncode == 0, got.stderr
    operators, pipeline = got.stdout.split()
    assert pipeline == "False" and (operators == "0") == ("promptspark/llm" in without)


def test_part_that_does_not_import(tmp_path):
    where = checkout(tmp_path)
    if not (where / "promptspark" / "llm").is_dir():
        pytest.skip("not in this checkout")
    (where / "promptspark" / "llm" / "bpe_codec.py").write_text("import no_such_module_here\n")
    got = run(where)
    assert got.returncode == 0 and got.stdout.split() == ["0", "False"] and "left out" in got.stderr
