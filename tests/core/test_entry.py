"""The driver's entry, with the optional subpackage and without it."""

import re
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]
TELL = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"


def told(root):
    out = subprocess.run([sys.executable, "-c", TELL], cwd=root, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": ""}, capture_output=True, text=True, check=True).stdout
    return [set(line.split()) for line in out.splitlines()[-2:]]


def test_without_the_subpackage(tmp_path):
    shutil.copytree(ROOT / "weir", tmp_path / "weir", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    queries, oracles = told(tmp_path)
    assert "event_pipeline" in queries and oracles <= queries and not [q for q in queries if re.match(r"op\d+_|pipeline$", q)]


def test_nothing_else_imports_the_subpackage():
    for p in [*(ROOT / "weir").rglob("*.py")]:
        if "llm" not in p.parts:
            assert not re.search(r"^\s*(from|import)\s+weir\.llm|from weir import .*\bllm\b", p.read_text(), re.M), p


def test_entry_runs(spark):
    import __spark_entry__

    got = __spark_entry__.entry(spark)
    assert got.columns == ["hour", "event_type", "n", "total", "k_sum"] and got.count() > 0
