from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from ledgerloom.session import local_session  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session("tests", memory="6g")


@pytest.fixture(scope="session")
def book(spark):
    from ledgerloom.plans.book import open_book

    return open_book(spark, DATA)
