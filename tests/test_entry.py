"""The entry without the training-data operators: their folders may be taken out, whole or but for what is left of them."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SHOW = "import __spark_entry__ as e; q = e.queries(); print(len(q), sum(k.startswith('op') or k == 'pipeline' for k in q), set(e.oracle_sql()) <= set(q))"


def shown(folder):
    done = subprocess.run([sys.executable, "-B", "-c", SHOW], cwd=folder, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(folder)}, timeout=300)
    return done.returncode, done.stdout.split(), done.stderr


@pytest.mark.parametrize("left", ["nothing", "empty folder", "caches"])
def test_entry_without_the_operators(tmp_path, left):
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        shutil.copy(f"{ROOT}/{name}", tmp_path)
    shutil.copytree(f"{ROOT}/shelfspark", tmp_path / "shelfspark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    if left != "nothing":
        (tmp_path / "shelfspark/llm").mkdir()
    if left == "caches":
        (tmp_path / "shelfspark/llm/__pycache__").mkdir()
        (tmp_path / "shelfspark/llm/__pycache__/queries.cpython-313.pyc").write_bytes(b"")
    code, out, err = shown(tmp_path)
    assert code == 0, err
    assert int(out[0]) > 170 and out[1:] == ["0", "True"]


def test_entry_with_an_operator_that_fails_says_so(tmp_path):
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        shutil.copy(f"{ROOT}/{name}", tmp_path)
    shutil.copytree(f"{ROOT}/shelfspark", tmp_path / "shelfspark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "shelfspark/llm").mkdir()
    (tmp_path / "shelfspark/llm/__init__.py").write_text("")
    (tmp_path / "shelfspark/llm/queries.py").write_text("import nothing_of_that_name")
    code, _, err = shown(tmp_path)
    assert code and "nothing_of_that_name" in err
