import sys
import tempfile
from contextlib import contextmanager
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    from voxlake.session import local_session

    session = local_session(8, **{"spark.sql.shuffle.partitions": "4"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


@pytest.fixture
def chunked(spark):
    """Set how many rows a group may have before it is cut."""

    @contextmanager
    def rows(n):
        spark.conf.set("spark.voxlake.chunkRows", str(n))
        try:
            yield
        finally:
            spark.conf.unset("spark.voxlake.chunkRows")

    return rows
