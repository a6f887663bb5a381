import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))

from tidemark.plans.series import CHUNK_ROWS_CONF  # noqa: E402
from tidemark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(os.environ.get("TEST_CPUS", "8"), "tests")
    yield session
    session.stop()


@pytest.fixture
def small_chunks(spark):
    """Chunks so small that every series spans many of them."""
    spark.conf.set(CHUNK_ROWS_CONF, "64")
    yield 64
    spark.conf.unset(CHUNK_ROWS_CONF)
