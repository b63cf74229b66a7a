import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from lumicat.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("lumicat-tests", cores="4")


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
