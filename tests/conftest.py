import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from strandframe.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests", spark__driver__memory="4g")
    yield session
    session.stop()


@pytest.fixture
def values(spark):
    """Values of Column expressions over one row."""

    def run(*cols, **fields):
        from pyspark.sql import functions as F

        row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in fields.items()]) if fields else spark.range(1)
        got = row.select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()
        return got[0] if len(cols) == 1 else tuple(got)

    return run
