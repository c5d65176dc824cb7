import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from gleaner.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g",
        "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def value(spark):
    """Evaluates column expressions on one row."""
    def run(*columns, **cells):
        row = spark.range(1)
        for name, cell in cells.items():
            row = row.withColumn(name, cell)
        out = row.select(*columns).first()
        return out[0] if len(columns) == 1 else tuple(out)
    return run
