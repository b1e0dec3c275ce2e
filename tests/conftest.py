import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tabscope.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(4, "tests", partitions=2)


GRID = "source string, sheet string, row_number bigint, cells array<string>"


@pytest.fixture(scope="session")
def make_grid(spark):
    def make(sheets, source="book"):
        rows = [(source, name, i, [None if c is None else str(c) for c in cells]) for name, grid in sheets.items() for i, cells in enumerate(grid, 1)]
        return spark.createDataFrame(rows, GRID)
    return make
