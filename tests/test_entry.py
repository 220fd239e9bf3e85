"""The entry without the corpus operators: all other queries are there."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
TELL = "import sys; sys.path.insert(0, sys.argv[1]); import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), len(o), any(n.startswith('op1_') or n == 'pipeline' for n in q), set(o) <= set(q))"


def tell(folder):
    run = subprocess.run([sys.executable, "-B", "-c", TELL, str(folder)], capture_output=True, text=True, cwd=folder, env={"PATH": "/usr/bin:/bin"})
    assert run.returncode == 0, run.stderr[-800:]
    return run.stdout.split()


def test_entry_without_corpus_operators(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    before = tell(copy)
    for gone in (copy / "lodestone" / "llm", copy / "tests" / "llm"):
        if gone.exists():
            shutil.rmtree(gone)
    with_pipeline = tell(copy)
    assert with_pipeline[2:] == ["False", "True"] and int(with_pipeline[0]) > 100
    (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    assert tell(copy) == with_pipeline
    assert int(before[0]) >= int(with_pipeline[0])
