import pytest

from redebit.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", app="redebit-tests", **{"spark.driver.memory": "8g"})
    yield session
    session.stop()
