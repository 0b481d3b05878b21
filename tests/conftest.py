import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from leafmill.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", 4)
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture()
def docs(spark):
    """Texts to a (doc_id, text) frame."""
    return lambda *texts: spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
