import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("LODESTRATA_DRIVER_MEMORY", "4g")


@pytest.fixture(scope="session")
def spark():
    from lodestrata.session import local_session

    s = local_session(cores="4", shuffle_partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def tiny():
    """The smallest driver tables; tests over them are skipped where they are absent."""
    d = Path("/root/testdata/sf0.001")
    if not d.exists():
        pytest.skip("no test tables here")
    return str(d)
