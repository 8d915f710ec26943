import os

os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")  # before numpy: its threads wait for ever beside Spark's on some machines

import pytest  # noqa: E402

from gridspark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
