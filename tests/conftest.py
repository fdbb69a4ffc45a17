import sys
import tempfile
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from pinprice.session import build_session  # noqa: E402

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", app_name="pinprice-tests", shuffle_partitions=8)
    if not s.sparkContext.getCheckpointDir():
        # tests only: no shared storage is configured, use a scratch folder
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="pinprice-test-ckpt-"))
    yield s
    s.stop()


OFFER_DDL = ("zone STRING, product BIGINT, pincodeNum INT, buyingPrice INT, "
             "sellingPrice DOUBLE, quantity INT")
PIN_DDL = "pincode INT, zone STRING"
DIST_DDL = "sourcePincode INT, destPincode INT, distance DOUBLE"
PROD_DDL = "product BIGINT"
PRICES_DDL = "product BIGINT, pincode INT, price BIGINT, quantity INT"
REQ_DDL = "request_id BIGINT, kind STRING, product BIGINT, zone STRING, dest_pin INT"


@pytest.fixture(scope="session")
def mk(spark):
    def make(rows, ddl):
        return spark.createDataFrame(rows, ddl)
    return make


def uniq(name):
    """A table name no earlier run can have used (the catalog may persist)."""
    import uuid

    return f"{name}_{uuid.uuid4().hex[:10]}"


def rows(df, order=None):
    cols = df.columns
    out = [tuple(r[c] for c in cols) for r in df.collect()]
    return sorted(out, key=lambda t: tuple((x is None, x) for x in t)) if order is None else out
