import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = (SparkSession.builder.master("local[4]").appName("basketry-tests")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.ui.enabled", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="basketry-test-ckpt-"))
    yield s
    s.stop()


@pytest.fixture()
def tmp_out(tmp_path):
    return str(tmp_path)


def lines_df(spark, baskets):
    """baskets: {order_id: [items]} -> (order_id, item) lines."""
    rows = [(int(k), int(i)) for k, items in baskets.items() for i in items]
    return spark.createDataFrame(rows, "order_id BIGINT, item BIGINT")


def arrays_df(spark, baskets):
    rows = [(int(k), [int(i) for i in items]) for k, items in baskets.items()]
    return spark.createDataFrame(rows, "order_id BIGINT, items ARRAY<BIGINT>")
