from __future__ import annotations

import pytest

from tonearm.session import local_session

from .parity import duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(memory="8g", shuffle_partitions=2)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def con():
    return duck(SF)


@pytest.fixture(scope="session")
def sf_dir():
    return SF
