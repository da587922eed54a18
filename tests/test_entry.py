"""The core queries stand on their own, whatever is left of the optional part."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
import sys
{before}
import __spark_entry__ as entry
assert set(entry.queries()) == set(entry.JOBS) and set(entry.oracle_sql()) == set(entry.JOBS)
assert not [m for m in sys.modules if m.startswith("statline.llm.queries")]
"""


def copied(tmp_path, *left_out):
    """The library without some of its parts."""
    for name in ("statline", "oracle"):
        shutil.copytree(
            f"{ROOT}/{name}", tmp_path / name, ignore=shutil.ignore_patterns("__pycache__", *left_out)
        )
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if name not in left_out and os.path.exists(f"{ROOT}/{name}"):
            shutil.copy(f"{ROOT}/{name}", tmp_path / name)
    return tmp_path


def imports(folder, before=""):
    command = [sys.executable, "-c", SCRIPT.format(before=before)]
    run = subprocess.run(command, cwd=folder, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr


def test_without_the_optional_part(tmp_path):
    imports(copied(tmp_path, "llm", "corpus_pipeline.py"))


def test_with_only_compiled_files_left(tmp_path):
    folder = copied(tmp_path, "llm")
    os.makedirs(folder / "statline/llm/__pycache__")
    imports(folder)


@pytest.mark.parametrize("package", ["ahocorasick", "xxhash"])
def test_with_a_package_missing(tmp_path, package):
    imports(copied(tmp_path), f"sys.modules[{package!r}] = None")
