"""The entry module stands without the training-data subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_without_the_subpackage(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for folder in ("probatio/llm", "tests/llm"):
        shutil.rmtree(copy / folder, ignore_errors=True)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'trust_score' in q and 'pipeline' not in q and not any(n.startswith('op1_') for n in q); assert set(o) <= set(q); print(len(q))"
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    for delete in (False, True):  # the driver deletes the pipeline too
        if delete:
            os.remove(copy / "corpus_pipeline.py")
        done = subprocess.run([sys.executable, "-c", code], cwd=copy, env=environment, capture_output=True, text=True, timeout=120)
        assert done.returncode == 0, done.stderr
