import pytest


@pytest.fixture(scope="session")
def empty(spark):
    """An empty table of the schema given."""
    return lambda ddl: spark.createDataFrame([], ddl)
