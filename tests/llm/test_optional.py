"""The rest of the library does not need the training-data subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_entry_without_the_subpackage(tmp_path):
    shutil.copytree(os.path.join(ROOT, "sentibar"), tmp_path / "sentibar",
                    ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    code = ("import __spark_entry__ as e; q = e.queries(); e.oracle_sql(); assert len(q) >= 95;"
            "assert not any(k.startswith('op') and k[2].isdigit() or k == 'pipeline' for k in q)")
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True,
                   env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_entry_with_it():
    code = ("import __spark_entry__ as e; q = e.queries();"
            "assert {k.split('_')[0] for k in q} >= {f'op{n}' for n in range(1, 14)} | {'pipeline'}")
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, env={**os.environ, "PYTHONPATH": ROOT})
