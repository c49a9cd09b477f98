import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from stocktake.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    scratch = tempfile.mkdtemp(prefix="stocktake-tests-")
    os.environ["STOCKTAKE_SCRATCH"] = scratch
    s = build_session("local[4]", shuffle_partitions=4, checkpoint_dir=os.path.join(scratch, "checkpoints"))
    yield s
    s.stop()


def records(spark, rows):
    """(id, json text) pairs -> DataFrame(id, rec variant)."""
    from pyspark.sql import functions as F
    return spark.createDataFrame(rows, "id long, body string").select("id", F.parse_json("body").alias("rec"))


def pages(spark, rows):
    """(endpoint, parent, page_no, status, body) -> landed pages."""
    import datetime as dt
    ts = dt.datetime(2024, 1, 1)
    full = [("ws", e, p, n, s, ts, b) for e, p, n, s, b in rows]
    return spark.createDataFrame(full, "workspace string, endpoint string, parent string, page_no int, "
                                       "status int, collected_at timestamp, body string")
