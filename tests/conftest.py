import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from martwright.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = get_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "6g", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))})
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def encounters(spark):
    """Twenty rows with planted defects: a negative age, mixed-case codes, missing text, a zero cost, one repeated row."""
    rows = [(f"P{i:03d}", 20 + i, "CA" if i % 2 else " ca ", None if i in (3, 7, 11) else f"dx{i % 4}",
             f"2024-01-{i:02d}", 100.5 * i) for i in range(1, 20)]
    rows[4] = ("P005", -5, "ny", "dx1", "2024-01-05", 0.0)
    rows.append(rows[-1])
    return spark.createDataFrame(rows, "PatientID string, age int, state string, diagnosis string, visit_date string, cost_usd double")


def as_set(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}
