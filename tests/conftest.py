import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMOKE = "/root/testdata/sf0.001"
SF_SMALL = "/root/testdata/sf0.01"
GOLDEN = os.path.join(ROOT, "tests", "golden")


@pytest.fixture(scope="session")
def spark():
    from binscore.session import get_session
    scratch = tempfile.mkdtemp(prefix="binscore-tests-")
    s = get_session("local[*]", 8, app_name="binscore-tests",
                    extra={"spark.checkpoint.dir": os.path.join(scratch, "ckpt")})
    yield s
    s.stop()
