import sys
from pathlib import Path

import pytest
from pyspark import cloudpickle

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from topicloom import get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_spark("tests", cores="8")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="module", autouse=True)
def by_value(request):
    """Functions of a test module reach the workers, which cannot import it."""
    cloudpickle.register_pickle_by_value(request.module)


def rows(df, *columns):
    """Rows as sorted tuples."""
    found = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in found.collect()), key=repr)
