import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
ASK = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), e.FLAGSHIP in q, 'pipeline' in q, any(n.startswith('op') and n[2].isdigit() for n in q))"


def copied(tmp_path, *without):
    """The repository's code in another folder, less some of it."""
    to = tmp_path / "copy"
    shutil.copytree(ROOT, to, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.json", "spark-warehouse", "metastore_db"))
    for name in without:
        path = to / name
        if path.is_dir():
            shutil.rmtree(path)
        elif path.exists():
            path.unlink()
    return to


def asked(folder):
    return subprocess.run([sys.executable, "-c", ASK], cwd=folder, capture_output=True, text=True, timeout=120)


@pytest.mark.parametrize("without", [("corpus_pipeline.py",), ()])
def test_the_rest_works_without_the_training_data_folders(tmp_path, without):
    folder = copied(tmp_path, "tidemark/llm", "tests/llm", *without)
    # A folder that only holds leftovers is no part of the library.
    (folder / "tidemark/llm/__pycache__").mkdir(parents=True)
    said = asked(folder)
    assert said.returncode == 0, said.stderr
    count, *flags = said.stdout.split()
    assert int(count) >= 133 and flags == ["True", "False", "False"]


def test_a_broken_import_is_not_taken_for_an_absent_part(tmp_path):
    folder = copied(tmp_path, "tidemark/llm", "tests/llm")
    part = folder / "tidemark/llm"
    part.mkdir()
    (part / "__init__.py").write_text("")
    (part / "queries.py").write_text("import a_module_that_is_not_there\n")
    said = asked(folder)
    assert said.returncode != 0 and "a_module_that_is_not_there" in said.stderr
