"""Every registered query of the library beside its SQL, on the smallest tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from compare import compare, connect  # noqa: E402

from treesift.checks import all_checks  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLE = all_checks()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert compare(spark, con, name, QUERIES[name], ORACLE.get(name), FOLDER) is None
