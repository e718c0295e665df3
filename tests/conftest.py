import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMOKE = "/root/testdata/sf0.001"
SF_SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    from mailsieve.session import ensure_checkpoint_dir
    s = (SparkSession.builder.master("local[*]")
         .config("spark.driver.memory", "8g")  # the one JVM of a local master runs every task
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.ui.retainedExecutions", "1")
         .config("spark.ui.retainedJobs", "20").config("spark.ui.retainedStages", "20").config("spark.ui.retainedTasks", "1000")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(s)
    yield s
    s.stop()


@pytest.fixture(scope="module", autouse=True)
def nothing_stays_cached():
    """What a module's queries persist goes with the module."""
    yield
    from pyspark.sql import SparkSession
    if (s := SparkSession.getActiveSession()) is not None:
        s.catalog.clearCache()


@pytest.fixture(scope="session")
def duck():
    import duckdb
    con = duckdb.connect()
    for t in ("documents labels pages benchmark conversations").split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMOKE}/{t}.parquet')")
    return con
