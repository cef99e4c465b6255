import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from forecourt.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("8")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture
def values(spark):
    """Evaluate a column expression over a list of inputs, in order."""
    from pyspark.sql import functions as F

    def run(expr, inputs, schema="string"):
        rows = [(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(inputs)]
        names = schema if "," in schema or " " in schema else f"x {schema}"
        df = spark.createDataFrame(rows, f"i int, {names}")
        return [r["out"] for r in df.select("i", expr(F).alias("out")).orderBy("i").collect()]

    return run
