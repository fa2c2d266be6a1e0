from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_without_the_optional_subpackage(tmp_path):
    shutil.copytree(ROOT / "lexifold", tmp_path / "lexifold", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py", "bench.py"):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path)
    show = "import bench, __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print(len(q), *[n for n in q if n[:2] == 'op' or n == 'pipeline'])"
    found = subprocess.run([sys.executable, "-c", show], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONDONTWRITEBYTECODE": "1"}, capture_output=True, text=True)
    assert found.returncode == 0, found.stderr
    n, *optional = found.stdout.split()
    assert int(n) > 100 and not optional
