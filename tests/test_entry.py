import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("gone", [["scorelark/llm", "tests/llm"], ["scorelark/llm", "tests/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_queries_stand_without_the_training_data_operators(tmp_path, gone):
    at = tmp_path / "copy"
    shutil.copytree(ROOT, at, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for name in gone:
        shutil.rmtree(at / name) if (at / name).is_dir() else (at / name).unlink(missing_ok=True)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), 'scorecard' in q, 'resume_parts' in o, 'pipeline' in q, any(n.startswith('op') and n[2].isdigit() for n in q), set(o) <= set(q))"
    run = subprocess.run([sys.executable, "-c", code], cwd=at, env={**os.environ, "PYTHONPATH": str(at)}, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
    n, card, parts, pipeline, ops, known = run.stdout.split()
    assert int(n) >= 45 and (card, parts, pipeline, known) == ("True", "True", "False", "True") and ops == str(gone == ["corpus_pipeline.py"])


def test_nothing_else_imports_the_training_data_operators():
    for path in (ROOT / "scorelark").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "scorelark").parts:
            assert "scorelark.llm" not in path.read_text(encoding="utf-8"), path
