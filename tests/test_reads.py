"""How often reports really read their tables, counted from Spark's event log."""

import json
import os
import subprocess
import sys

import pytest

from statline.constants import POSITIONS
from statline.sources.sample import SampleTables
from statline.sources.tables import write_tables

SF_DIR = "/root/testdata/sf0.001"
ONCE = ("gamelogs", "teams", "parkconfig", "batting", "pitching")


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    write_tables(SampleTables(spark, SF_DIR), path)
    return path


@pytest.mark.parametrize("folder", [False, True])
def test_two_reports_read_each_table_once(stored, tmp_path, folder):
    """Fielders twice: for their totals and one by one. With and without a named folder."""
    here = os.path.dirname(os.path.abspath(__file__))
    (tmp_path / "log").mkdir()
    command = [sys.executable, f"{here}/reads.py", stored, str(tmp_path / "log")]
    command += [str(tmp_path / "shared")] if folder else []
    run = subprocess.run(command, capture_output=True, text=True, timeout=300,
                         env=os.environ | {"PYTHONPATH": os.path.dirname(here)})
    assert run.returncode == 0, run.stderr[-2000:]
    found = json.loads(run.stdout.splitlines()[-1])
    assert found["rows"][0] == found["rows"][1] > 0
    reads = found["reads"]
    assert {name: reads.get(name) for name in ONCE} == dict.fromkeys(ONCE, 1)
    for pos in POSITIONS:
        assert 1 <= reads[f"fielding_{pos}"] <= 2, pos
    stages = [p for p in tmp_path.rglob("stages/*") if p.is_dir()]
    assert len(stages) == (7 if folder else 0)
