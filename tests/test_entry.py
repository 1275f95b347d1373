from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("without", [(), ("provenir/llm",), ("provenir/llm", "corpus_pipeline.py")])
def test_the_contract_imports_without_the_subpackage(tmp_path, without):
    gone = [str(ROOT / name) for name in without]

    def left_out(folder, names):
        return [n for n in names if f"{folder}/{n}" in gone or n == "__pycache__"]

    shutil.copytree(ROOT / "provenir", tmp_path / "provenir", ignore=left_out)
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if name not in without and (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path / name)
    script = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op') for n in q), set(e.oracle_sql()) <= set(q))"
    out = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    count, operators, named = out.stdout.split()
    assert int(count) > 60 and named == "True"
    assert operators == str(not without and (ROOT / "provenir/llm").exists())
