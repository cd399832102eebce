from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from quire.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = local_session(cores="*", shuffle_partitions=8, app="quire-tests")
    yield s
    s.stop()


def rows(df, *cols):
    """Collect as a list of tuples (ordered as the frame is)."""
    cols = cols or df.columns
    return [tuple(r[c] for c in cols) for r in df.collect()]
