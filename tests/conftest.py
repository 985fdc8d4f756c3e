import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from palisade.operators.running import GROUP_LIMIT_CONF  # noqa: E402
from palisade.session import local_session, ship_packages  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", "4")
    ship_packages(session, os.path.join(ROOT, "palisade"), os.path.join(ROOT, "contract"))
    yield session
    session.stop()


@pytest.fixture(params=["window", "cut"])
def way(spark, request):
    """Run a test both ways ordered operators work."""
    spark.conf.set(GROUP_LIMIT_CONF, "1000000" if request.param == "window" else "0")
    yield request.param
    spark.conf.unset(GROUP_LIMIT_CONF)
