"""The registry works with and without the corpus operators."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).parent.parent
ASK = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(n.startswith('op') or n == 'pipeline' for n in e.queries()))"


def asked(folder, *before):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONDONTWRITEBYTECODE": "1"}
    done = subprocess.run([sys.executable, "-c", "; ".join([*before, ASK])], cwd=folder, env=env, capture_output=True, text=True, check=False)
    assert done.returncode == 0, done.stderr
    return done.stdout.split()


@pytest.mark.parametrize("gone", [["tabsift/llm", "tests/llm", "corpus_pipeline.py"], ["tabsift/llm", "tests/llm"], ["corpus_pipeline.py"]])
def test_without_the_corpus_operators(tmp_path, gone):
    shutil.copytree(ROOT, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "__pycache__"))
    for name in gone:
        place = tmp_path / "copy" / name
        shutil.rmtree(place) if place.is_dir() else place.unlink(missing_ok=True)
    found, sql, corpus = asked(tmp_path / "copy")
    assert int(found) > 20 and int(sql) > 20 and (corpus == "True") == (gone == ["corpus_pipeline.py"] and (ROOT / "tabsift/llm").is_dir())


def test_without_the_vocabulary_files():
    assert asked(ROOT, "import sys", "sys.modules['public_tokenizers'] = None")[2] == "False"
