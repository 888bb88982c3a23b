import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from datarights.session import local_session
    from datarights.streaming.streams import use_state_store

    session = local_session("tests", cpus=8, memory="8g")
    use_state_store(session)
    yield session
    session.stop()


def rows(df, *columns):
    """Sorted tuples of a DataFrame, for comparing small results."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)
