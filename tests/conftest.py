import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    own = tempfile.mkdtemp(prefix="spark-")
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.local.dir", own).config("spark.sql.warehouse.dir", f"{own}/warehouse").config("spark.checkpoint.dir", f"file://{own}/shared")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    from attestra.plans.shipping import ship

    yield ship(session)
    session.stop()
