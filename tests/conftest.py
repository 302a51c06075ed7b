import pytest

from partweave.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(cpus=4, memory="6g", shuffle_partitions=4)
    yield s


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
