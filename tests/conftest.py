import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH", "")]))


@pytest.fixture(scope="session")
def spark():
    from seqmap.session import local_session

    session = local_session(cores=4, partitions=4, memory="3g", name="tests")
    session.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", "4")
    yield session
    session.stop()


SF = "/root/testdata/sf0.001"
