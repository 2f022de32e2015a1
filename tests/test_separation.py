"""The library without its optional subpackage."""

import pathlib
import shutil
import subprocess
import sys

ROOT = pathlib.Path(__file__).resolve().parent.parent
ASK = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), len(o), any(n.startswith('op') or n == 'pipeline' for n in q))"


def counted(home, *gone):
    shutil.copytree(ROOT, home, ignore=shutil.ignore_patterns(".git", "__pycache__", *gone))
    said = subprocess.run([sys.executable, "-c", ASK], cwd=home, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
    return said.stdout.split()[-3:]


def test_imports_without_subpackage(tmp_path):
    some = counted(tmp_path / "a", "llm", "corpus_pipeline.py")
    # empty folders may stay behind, and the pipeline's module may too
    also = counted(tmp_path / "b", "llm")
    assert some == also and int(some[0]) > 90 and some[2] == "False"


def test_nothing_else_imports_it():
    for f in ROOT.glob("corpusloom/**/*.py"):
        if "llm" not in f.relative_to(ROOT).parts:
            assert "corpusloom.llm" not in f.read_text(), f
