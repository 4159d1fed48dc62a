from __future__ import annotations

import pytest

from clustrial.session import local_session
from clustrial.sources import tables


@pytest.fixture(scope="session")
def checkpoint_dir(tmp_path_factory):
    return str(tmp_path_factory.mktemp("shared"))


@pytest.fixture(scope="session")
def spark(checkpoint_dir):
    session = local_session("tests", 4, spark__checkpoint__dir=checkpoint_dir)
    yield session
    session.stop()


@pytest.fixture
def many_slices(spark, monkeypatch):
    """Cut every ordered table into more slices than it has by itself."""
    monkeypatch.setattr(tables, "MIN_SLICES", 9)


@pytest.fixture(params=["few slices", "many slices"])
def sliced(request):
    """Run a test with the least number of slices, and again with more."""
    if request.param == "many slices":
        request.getfixturevalue("many_slices")
    return request.param


def rows(df, *order):
    """Sorted tuples of a frame."""
    columns = order or df.columns
    picked = [tuple(r[c] for c in columns) for r in df.collect()]
    return sorted(picked, key=lambda row: [(v is not None, v) for v in row])
