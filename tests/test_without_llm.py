"""The library without its llm subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_the_rest_works_when_llm_is_deleted(tmp_path):
    for name in ("glyphwarden", "corpus_pipeline.py", "__spark_entry__.py"):
        source = os.path.join(ROOT, name)
        if os.path.isdir(source):
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif os.path.exists(source):
            shutil.copy(source, tmp_path / name)
    said = subprocess.run(
        [sys.executable, "-c", "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(len(q), set(s) <= set(q), any(n.startswith('op') for n in q), 'pipeline' in q)"],
        cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True,
    )
    n, *rest = said.stdout.split()
    assert int(n) > 50 and rest == ["True", "False", "False"], said.stderr
