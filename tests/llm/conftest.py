import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from kerbside.llm.store import ship  # noqa: E402


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)
