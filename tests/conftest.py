import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tessera.session import build_session, discard_tables  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    spark = build_session(4, app="tessera-tests", **{"spark.sql.shuffle.partitions": "4"})
    yield spark
    discard_tables(spark)


@pytest.fixture(scope="session")
def sf_dir():
    return SF
