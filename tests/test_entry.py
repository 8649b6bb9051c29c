"""The entry module keeps working when the training-data parts are taken away."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _names(root):
    code = "import __spark_entry__ as e, json; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"
    env = os.environ | {"PYTHONPATH": root}
    done = subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=root, env=env, capture_output=True, text=True, check=True)
    import json

    return json.loads(done.stdout.splitlines()[-1])


def test_queries_without_the_training_data_parts(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__", "llm"))
    every, oracles = _names(str(tmp_path / "repo"))
    assert "lod_select" in every and "lod_select" in oracles and not [n for n in every if n.startswith("op") or n == "pipeline"]
    os.remove(tmp_path / "repo/corpus_pipeline.py")
    assert _names(str(tmp_path / "repo")) == [every, oracles]
