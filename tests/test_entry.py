"""The driver's contract, with and without the training-data subpackage."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.oracle_sql()) >= 45


def test_without_the_subpackage(tmp_path):
    for name in ("__spark_entry__.py", "tracewarden"):
        (shutil.copytree if os.path.isdir(f"{ROOT}/{name}") else shutil.copy)(f"{ROOT}/{name}", tmp_path / name)
    shutil.rmtree(tmp_path / "tracewarden/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'traj_length' in q and not [x for x in q if x.startswith('op') and x[2].isdigit()]; assert 'pipeline' not in q"
    env = os.environ | {"PYTHONPATH": str(tmp_path)}
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env).returncode == 0


def test_nothing_else_imports_it():
    for folder, _, files in os.walk(f"{ROOT}/tracewarden"):
        if "/llm" not in folder:
            for f in files:
                if f.endswith(".py"):
                    assert "tracewarden.llm" not in open(f"{folder}/{f}").read(), f
