import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from shelfline.session import local_session  # noqa: E402
from shelfline.sources.roles import Tables  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = {"spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))}
    session = local_session(8, "shelfline-tests", shared)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables(spark):
    return Tables(spark, SMALL)


@pytest.fixture(scope="session")
def rows():
    """Collected rows as dictionaries, optionally keyed by a column."""

    def collect(df, key=None):
        out = [r.asDict() for r in df.collect()]
        return {r[key]: r for r in out} if key else out

    return collect
