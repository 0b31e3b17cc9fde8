import pytest
from odd_documents import duck_tables


@pytest.fixture(scope="session")
def duck():
    return duck_tables()
