import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]


@pytest.fixture(scope="session")
def spark():
    from compare import session

    s = session(partitions="4")
    yield s
    s.stop()


@pytest.fixture(autouse=True)
def tables_of_the_test(request):
    """What a test materializes goes with it; fixtures of wider scope keep theirs until the end."""
    if "spark" not in request.fixturenames:
        yield
        return
    from perennial.functions.storage import owned_tables

    with owned_tables(request.getfixturevalue("spark")):
        yield
