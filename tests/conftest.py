import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from docloom.session import local_session  # noqa: E402

DATA = os.environ.get("DOCLOOM_TESTDATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests", **{"spark.driver.memory": "4g", "spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return f"{DATA}/sf0.01"


def rows(df, *names):
    """Rows as sorted tuples of the named columns."""
    return sorted((tuple(r[n] for n in (names or df.columns)) for r in df.collect()), key=lambda t: tuple((x is not None, x) for x in t))
