"""The repository without the operators for training data."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

CODE = """
import sys, __spark_entry__ as e
names = set(e.queries())
assert names and not [n for n in names if n.startswith("op")] and "pipeline" not in names
assert set(e.oracle_sql()) <= names
import bench
"""


def copy_without_llm(to):
    skip = shutil.ignore_patterns("llm", ".git", "__pycache__", "*.json", ".pytest_cache")
    shutil.copytree(ROOT, to, ignore=skip)


def test_the_rest_imports_without_the_llm_folders(tmp_path):
    for pipeline in (True, False):
        root = tmp_path / str(pipeline)
        copy_without_llm(root)
        if not pipeline and (root / "corpus_pipeline.py").exists():
            (root / "corpus_pipeline.py").unlink()
        env = {**os.environ, "PYTHONPATH": str(root)}
        done = subprocess.run([sys.executable, "-c", CODE], cwd=root, env=env, capture_output=True, text=True)
        assert done.returncode == 0, done.stderr


def test_nothing_outside_imports_the_llm_package():
    for folder, _, files in os.walk(os.path.join(ROOT, "paceline")):
        for name in files:
            if name.endswith(".py") and f"{os.sep}llm" not in folder:
                assert "paceline.llm" not in open(os.path.join(folder, name)).read()
