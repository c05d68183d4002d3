import os
import sys
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))


def make_spark():
    spark = (SparkSession.builder.master(f"local[{os.environ.get('TEST_CPUS', '8')}]").appName("reviewlens-tests")
             .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
             .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "12g")
             .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="reviewlens-tests-"))
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@pytest.fixture(scope="session")
def spark():
    session = make_spark()
    yield session
    session.stop()
