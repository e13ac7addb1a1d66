from __future__ import annotations

import pytest

from orewright.llm.common import sweep


@pytest.fixture(scope="session", autouse=True)
def swept(spark):
    yield
    sweep(spark)
