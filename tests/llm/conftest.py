import os

import pytest

DATA = os.environ.get("PAIRLENS_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def sf_dir():
    return DATA
