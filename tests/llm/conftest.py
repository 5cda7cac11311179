import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

from gondola.llm.shared import prepare  # noqa: E402


@pytest.fixture(autouse=True)
def _prepared(spark):
    prepare(spark)
