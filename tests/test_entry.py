"""The entry point, with and without the folder llm and the pipeline."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_names_without_llm(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; n = e.queries(); assert len(n) > 60 and not [k for k in n if k.startswith('op') or k == 'pipeline'], n; print('fine')"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""})
    assert out.stdout.strip() == "fine", out.stderr


def test_other_import_errors_are_not_swallowed(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__"))
    (tmp_path / "r/corpus_pipeline.py").write_text("import nothing_of_this_name\n")
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path / "r", capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""})
    assert "nothing_of_this_name" in out.stderr and out.returncode
