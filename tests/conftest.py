import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from vigilday.functions.storage import drop_stored  # noqa: E402
from vigilday.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = local_session(4, "tests", str(shared))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    drop_stored(session)
    assert not list(shared.glob("*/stored-*"))
    session.stop()


def rows(df):
    """The rows of a small frame in one order."""
    return sorted(map(tuple, df.collect()), key=str)
