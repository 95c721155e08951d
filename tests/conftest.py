import pytest

from sievework.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture
def rows():
    """Collect as sorted plain tuples."""

    def run(df, *cols):
        got = [tuple(r) for r in (df.select(*cols) if cols else df).collect()]
        return sorted(got, key=repr)

    return run
