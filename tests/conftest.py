import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from rillwork.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_session(
        "tests",
        "local[4]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"},
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def cells(spark, grid):
    """Long cell table of a nested list or array."""
    rows = [("r", i, j, None if v is None else float(v), i * len(grid[0]) + j) for i, line in enumerate(grid) for j, v in enumerate(line)]
    return spark.createDataFrame(rows, "raster string, row int, col int, z double, cell long")
