"""The entry works without the optional training-data parts."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_the_optional_parts(tmp_path):
    shutil.copytree(os.path.join(ROOT, "sentibar"), tmp_path / "sentibar",
                    ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    code = ("import __spark_entry__ as e; q = e.queries(); s = e.oracle_sql();"
            "assert len(q) >= 110 and set(s) <= set(q);"
            "assert not any(k.startswith('op') and k[2].isdigit() or k == 'pipeline' for k in q)")
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True,
                   env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_no_module_of_the_library_needs_them():
    top = os.path.join(ROOT, "sentibar")
    for folder, _, names in os.walk(top):
        if os.path.join(top, "llm") in folder:
            continue
        for name in names:
            if name.endswith(".py"):
                with open(os.path.join(folder, name)) as f:
                    assert "llm" not in [w for line in f if "import" in line for w in line.replace(".", " ").split()], name
