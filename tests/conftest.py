import pytest

from cueloom.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", **{"spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()
