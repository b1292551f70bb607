import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from storeline.session import local_session
    s = local_session(cores="*", shuffle_partitions=8, app="storeline-tests")
    # tests own their checkpoint folder (a cluster names a shared one in spark.checkpoint.dir)
    s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="storeline-test-ckpt-"))
    yield s


SF_SMALL = "/root/testdata/sf0.001"
