import pytest

from eventtally.llm.tables import share_package


@pytest.fixture(scope="session", autouse=True)
def shared(spark):
    share_package(spark)
