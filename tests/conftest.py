import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from trajspark.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", partitions=4, app="trajspark-tests")
    yield session
    session.stop()


CELL_COLUMNS = "barcode string, patient_alias string, treatment string, clone_id string, timepoint int"


@pytest.fixture(scope="session")
def make_cells(spark):
    """Cells from ``{(patient, treatment, clone, timepoint): count}``."""

    def build(counts):
        rows = []
        for (patient, treatment, clone, timepoint), n in counts.items():
            for _ in range(n):
                rows.append((f"b{len(rows)}", patient, treatment, clone, timepoint))
        return spark.createDataFrame(rows, CELL_COLUMNS)

    return build
