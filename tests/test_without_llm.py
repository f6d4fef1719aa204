"""The registry without the optional subpackage."""

import os
import shutil
import subprocess
import sys

REPOSITORY = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _listed(folder):
    """Names in both registries, read by a process of its own that starts in another folder."""
    code = ("import sys; sys.path.insert(0, sys.argv[1]); import __spark_entry__ as e; "
            "print(len(e.queries()), len(e.oracle_sql()), sum(n.startswith('op') for n in e.queries()))")
    out = subprocess.run([sys.executable, "-c", code, str(folder)], cwd="/", capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    return tuple(map(int, out.stdout.split()))


def _copy(tmp_path, *without):
    folder = tmp_path / "copy"
    shutil.copytree(REPOSITORY, folder, ignore=lambda at, names: {
        n for n in names if n in (".git", "__pycache__") or os.path.relpath(os.path.join(at, n), REPOSITORY) in without})
    return folder


def test_registry_without_the_subpackage(tmp_path):
    from workload.oracles import ORACLES
    from workload.queries import QUERIES

    # corpus_pipeline.py stays here: it must not be imported without what it needs
    assert _listed(_copy(tmp_path, "rateweave/llm", "tests/llm")) == (len(QUERIES), len(ORACLES), 0)


def test_registry_without_the_pipeline(tmp_path):
    n, _, more = _listed(_copy(tmp_path, "rateweave/llm", "tests/llm", "corpus_pipeline.py"))
    assert n > 0 and more == 0
