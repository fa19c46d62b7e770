import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from covista.runtime import ensure_checkpoint_dir, local_session
    s = local_session("*")
    ensure_checkpoint_dir(s, fallback=tempfile.mkdtemp(prefix="covista-test-ckpt-"))
    yield s
