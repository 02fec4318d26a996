import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from lexidx.session import build_session, checkpoint_root
    s = build_session("local[4]", "lexidx-tests", shuffle_partitions=8)
    checkpoint_root(s)  # set one only when the session has none
    yield s
    s.stop()


@pytest.fixture
def tmp_dir():
    return tempfile.mkdtemp(prefix="lexidx-test-")


def write_lines(folder, lines, name="docs.ndjson"):
    path = os.path.join(folder, name)
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")
    return path
