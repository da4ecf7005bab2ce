"""Everything but the training-data operators works without them."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_without_the_training_data_operators(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__"))
    say = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in q), set(e.oracle_sql()) <= set(q))"
    run = lambda **env: subprocess.run([sys.executable, "-B", "-c", say], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)} | env, capture_output=True, text=True, timeout=300)
    for gone in ((), ("corpus_pipeline.py",)):
        for name in gone:
            (copy / name).unlink()
        result = run()
        assert result.returncode == 0, result.stderr
        count, separable, known = result.stdout.split()
        assert int(count) > 140 and (separable, known) == ("False", "True")
