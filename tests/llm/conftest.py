import pytest


@pytest.fixture(scope="session")
def rows_of():
    return lambda df: sorted(tuple(r) for r in df.collect())
