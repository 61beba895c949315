"""The library stands without the operators on training text."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PARTS = ("maskwright", "checks", "__spark_entry__.py", "corpus_pipeline.py")


def test_entry_without_the_subpackage(tmp_path):
    for keep_pipeline in (True, False):
        root = tmp_path / str(keep_pipeline)
        for part in PARTS:
            source = os.path.join(ROOT, part)
            if os.path.isdir(source):
                shutil.copytree(source, root / part, ignore=lambda d, names: [n for n in names if n in ("llm", "__pycache__")])
            elif os.path.exists(source) and (keep_pipeline or part != "corpus_pipeline.py"):
                shutil.copy(source, root / part)
        say = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())"
        done = subprocess.run([sys.executable, "-c", say], cwd=root, capture_output=True, text=True, timeout=120)
        assert done.returncode == 0, done.stderr
        n, sql, pipeline = done.stdout.split()
        assert int(n) > 40 and int(sql) > 40 and pipeline == "False"
