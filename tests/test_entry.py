"""The entry module with and without what it adds if it can be imported."""

import os
import shutil
import subprocess
import sys

from conftest import ROOT

LIST = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), 'pipeline' in q)"


def listed(folder, code=LIST):
    out = subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(folder)})
    assert out.returncode == 0, out.stderr
    return out.stdout.split()


def copied(tmp_path):
    for name in ("__spark_entry__.py", "segmentry"):
        src = os.path.join(ROOT, name)
        if os.path.isdir(src):
            shutil.copytree(src, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(src, tmp_path / name)
    return tmp_path


def test_library_alone(tmp_path):
    from segmentry.queries import QUERIES

    folder = copied(tmp_path)
    assert listed(folder) == [str(len(QUERIES)), "False"]
    # What version control leaves of a deleted folder must not count as the folder.
    (folder / "segmentry" / "llm" / "__pycache__").mkdir(parents=True)
    assert listed(folder) == [str(len(QUERIES)), "False"]
    (folder / "corpus_pipeline.py").write_text("from segmentry.llm import absent\n")
    assert listed(folder) == [str(len(QUERIES)), "False"]
