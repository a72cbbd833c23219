import datetime as dt
import os
import sys
import tempfile
from decimal import Decimal

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from tallyspark.schema import LEDGER_SCHEMA  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    from tallyspark.session import SESSION_CONF
    b = (SparkSession.builder.master("local[4]").appName("tallyspark-tests")
         .config("spark.sql.shuffle.partitions", "4")
         .config("spark.driver.memory", "8g")
         .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tally-test-ckpt-")))
    for k, v in SESSION_CONF.items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def D(s):
    return dt.date.fromisoformat(s)


def M(x):
    return Decimal(str(x)).quantize(Decimal("0.01"))


@pytest.fixture
def make_ledger(spark):
    """Build a ledger from tuples (tx_id, user_id, t_type, category, amount, date, note)."""
    def _make(rows):
        data = [(r[0], r[1], r[2], r[3], None if r[4] is None else M(r[4]),
                 None if r[5] is None else D(r[5]), r[6] if len(r) > 6 else None) for r in rows]
        return spark.createDataFrame(data, LEDGER_SCHEMA)
    return _make


def collect(df, order=None):
    rows = df.orderBy(*order).collect() if order else df.collect()
    return [r.asDict() for r in rows]
