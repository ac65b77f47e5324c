import os
import sys
import tempfile

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from voltaic.session import get_session  # noqa: E402
from voltaic.sources.tables import TABLE_NAMES  # noqa: E402

SF_SMALL = os.environ.get("VOLTAIC_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    ckpt = tempfile.mkdtemp(prefix="voltaic-test-ckpt-")
    s = get_session("local[*]", 8, extra={"spark.checkpoint.dir": ckpt, "spark.driver.memory": "4g"})
    s.sparkContext.setCheckpointDir(ckpt)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_SMALL


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLE_NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    yield con
    con.close()
