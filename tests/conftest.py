from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from arcwatch.session import local_session

    return local_session(4, 4, "4g")


@pytest.fixture(scope="session")
def sf_dir() -> str:
    return DATA
