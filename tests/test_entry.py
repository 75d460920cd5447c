from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_the_rest_works_without_the_optional_subpackage(tmp_path):
    """As when the subpackage, the pipeline made of it and their tests are deleted."""
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for deleted in (["passagework/llm", "tests/llm"], ["corpus_pipeline.py"]):
        for name in deleted:
            shutil.rmtree(copy / name) if (copy / name).is_dir() else (copy / name).unlink()
        code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q) and not any(n.startswith('op') or n == 'pipeline' for n in q) and len(q) > 50; print(callable(e.entry))"
        done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=120)
        assert done.returncode == 0 and done.stdout.strip() == "True", done.stderr
