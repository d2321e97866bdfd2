import os

import pytest

from palimpsest.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(cores=os.environ.get("TEST_CPUS", "4"), partitions=4, memory="4g")
    yield s
    s.stop()
