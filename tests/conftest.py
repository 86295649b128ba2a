import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from mediasignals.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests", "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
            "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def value(spark):
    """Evaluate a column expression over one row of named text values."""

    def evaluate(expression, **columns):
        names = list(columns) or ["x"]
        schema = ", ".join(f"{n} {_type(columns.get(n))}" for n in names)
        row = spark.createDataFrame([tuple(columns.get(n) for n in names)], schema)
        return row.select(expression.alias("v")).first()["v"]

    def _type(v):
        if isinstance(v, list):
            return "array<string>"
        return "int" if isinstance(v, int) else "string"

    return evaluate
