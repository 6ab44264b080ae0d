"""The entry module without the training-data folders."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = """
import __spark_entry__ as e
from deltaloom.session import session
names = e.queries()
assert names and "pipeline" not in names and not any(n.startswith("op") and n[2].isdigit() for n in names), names
assert set(e.oracle_sql()) <= set(names)
spark = session("alone", spark_master="local[2]", spark_sql_shuffle_partitions="2", spark_ui_enabled="false")
assert e.entry(spark).count() > 0
"""


def test_entry_works_without_the_training_data_operators(tmp_path):
    own = tmp_path / "repo"
    shutil.copytree(ROOT, own, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "llm"))
    shutil.copytree(os.path.join(ROOT, "tests"), own / "tests", ignore=shutil.ignore_patterns("__pycache__", "llm"), dirs_exist_ok=True)
    assert not (own / "deltaloom" / "llm").exists() and (own / "corpus_pipeline.py").exists() == os.path.exists(os.path.join(ROOT, "corpus_pipeline.py"))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | ({"PYTHONPATH": os.environ["PYTHONPATH"]} if "PYTHONPATH" in os.environ and ROOT not in os.environ["PYTHONPATH"] else {})
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=own, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
