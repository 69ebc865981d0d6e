import pytest

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from binsight.session import build_session
    s = build_session("local[4]", shuffle_partitions=8, app_name="binsight-tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
