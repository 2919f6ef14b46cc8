import pytest

from tidewell.session import build


@pytest.fixture(scope="session")
def spark():
    s = build("local[4]", shuffle_partitions=4, memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
