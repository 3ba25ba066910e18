"""The rest of the library stands without the training-data subpackage."""

from __future__ import annotations

import re
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parent.parent


def test_nothing_else_imports_the_subpackage():
    own = [p for p in (ROOT / "quillgraph").rglob("*.py") if "llm" not in p.relative_to(ROOT).parts]
    assert own and not [p for p in own if re.search(r"quillgraph\.llm|from quillgraph import llm", p.read_text())]


def test_entry_imports_without_it(tmp_path):
    shutil.copytree(ROOT / "quillgraph", tmp_path / "quillgraph", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not [n for n in q if n.startswith('op') or n == 'pipeline']; assert set(e.oracle_sql()) <= set(q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=False).returncode == 0


def test_queries_state_their_scale_limits():
    """No registered query collects rows of a table, samples it or runs a Python row function."""
    for p in (ROOT / "quillgraph" / "plans").glob("*.py"):
        text = p.read_text()
        assert not re.search(r"\.rdd\b|\.sample\(|F\.udf\(|crossJoin|localCheckpoint|toPandas", text), p
