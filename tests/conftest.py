import pytest

from factloom import runtime


@pytest.fixture(scope="session")
def spark():
    s = runtime.session("tests", cores=8, memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    yield s
    s.stop()
