import pytest

from visitlake.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("visitlake-tests", master="local[8]", **{"spark.driver.memory": "4g"})
    yield session
    session.stop()


@pytest.fixture
def cut_groups(spark):
    """Make every group above a few rows count as large, so the cut path runs on small fixtures."""
    from visitlake.operators.running import HOT_ROWS_CONF

    spark.conf.set(HOT_ROWS_CONF, "20")
    yield
    spark.conf.unset(HOT_ROWS_CONF)
