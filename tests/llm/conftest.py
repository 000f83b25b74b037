import pytest


@pytest.fixture(scope="session")
def rows(spark):
    """Collected rows of a frame built from tuples and a schema, through a function."""

    def made(data, schema, f=lambda df: df):
        return f(spark.createDataFrame(data, schema)).collect()

    return made
