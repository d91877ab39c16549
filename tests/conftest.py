import pytest

from tarnwork.session import get_spark


@pytest.fixture(scope="session")
def spark():
    return get_spark("4", 2, "4g")
