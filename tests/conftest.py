import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from toxiscope.session import local_session
    s = local_session(cores=4, shuffle_partitions=4, app="toxiscope-tests")
    yield s


@pytest.fixture(scope="session")
def small_chain(spark):
    from toxiscope.plans.baselines import chain
    return chain(spark, SF_SMALL)
