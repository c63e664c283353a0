"""The rest of the library lives without the training-data subpackage."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

USE = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as e
q, o = e.queries(), e.oracle_sql()
assert set(o) <= set(q) and len(q) >= 100, len(q)
print(len([n for n in q if n.startswith("op")]), "pipeline" in q)
if {run!r}:
    from regressa.session import get_session
    spark = get_session("local[2]", 2, driver_memory="1g")
    print(q["validate_nation"](spark, "/root/testdata/sf0.001").count())
"""


def _use(root, run=False, blocked=()):
    block = "".join(f"import sys; sys.modules[{m!r}] = None\n" for m in blocked)
    done = subprocess.run([sys.executable, "-c", block + USE.format(root=str(root), run=run)],
                          cwd=str(root), capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    return done.stdout.split()


@pytest.fixture
def tree(tmp_path):
    """A copy of the tree that lacks the two folders."""
    copy = tmp_path / "tree"
    skip = shutil.ignore_patterns("llm", "tests", ".git", "__pycache__")
    shutil.copytree(ROOT, copy, ignore=skip)
    return copy


def test_without_the_folders_but_with_the_pipeline(tree):
    if os.path.exists(os.path.join(ROOT, "corpus_pipeline.py")):
        assert (tree / "corpus_pipeline.py").exists()
    out = _use(tree, run=True)
    assert out[:2] == ["0", "False"] and int(out[-1]) > 0


def test_without_the_pipeline_either(tree):
    (tree / "corpus_pipeline.py").unlink(missing_ok=True)
    assert _use(tree) == ["0", "False"]


def test_missing_libraries_remove_only_the_training_data_queries():
    blocked = ["xxhash", "tiktoken", "tokenizers", "regex"]
    assert _use(ROOT, blocked=blocked) == ["0", "False"]
