from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from provenir.session import clear_stages, local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, memory="4g", app="tests")
    session.conf.set("spark.sql.shuffle.partitions", "2")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    clear_stages(session)


@pytest.fixture(scope="session")
def table(spark):
    from provenir.session import small_table

    return lambda rows, schema: small_table(spark, rows, schema)
