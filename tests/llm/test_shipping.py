"""Workers need no copy of the package: queries run from a folder without it, in a process of their own."""

import subprocess
import sys
from pathlib import Path

import pytest
from rows import FOLDER

REPO = Path(__file__).resolve().parents[2]
PROGRAM = """
import sys
sys.path.insert(0, {repo!r})
import __spark_entry__ as entry
from voxlake.session import local_session
spark = local_session(4)
print("ROWS", entry.queries()[{name!r}](spark, {folder!r}).count())
# That a worker really has no copy:
found = spark.range(1).rdd.map(lambda _: __import__("importlib.util").util.find_spec("voxlake") is not None).collect()
print("COPY", found[0])
"""


@pytest.mark.parametrize("name", ["op2_noisy_toxicity", "op12_simplex_clusters", "pipeline"])
def test_workers_without_the_package(name, tmp_path):
    import os

    clean = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    ran = subprocess.run(
        [sys.executable, "-c", PROGRAM.format(repo=str(REPO), name=name, folder=FOLDER)], cwd=tmp_path, env=clean, capture_output=True, text=True, timeout=900)
    assert "ROWS" in ran.stdout and "COPY False" in ran.stdout, ran.stderr[-2000:]
