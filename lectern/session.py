"""Session factory for local runs; on a cluster the caller brings its own session."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
#: Bytes of a batch on its way to Python, unless the session sets its own; rows of any length stay bounded.
BATCH_BYTES = 8 << 20
_DEFAULT_BYTES = 64 << 20


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each Spark application, bounds Arrow batches by bytes, and has unions shuffled anew.

    Spark 4.1 may take a union of inputs that are partitioned by a key for partitioned itself where it isn't, and then loses groups
    and matches: tests/test_core.py has a case. Without that, rows after such a union are shuffled, and right.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key).rstrip("bB") == str(_DEFAULT_BYTES):
        spark.conf.set(key, str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    here = os.path.dirname(os.path.abspath(__file__))
    if not os.path.isdir(here):  # already inside an archive that Spark carries
        return
    to = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="lectern-")), "lectern.zip")
    with zipfile.ZipFile(to, "w") as z:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("lectern", os.path.relpath(path, here)))
    spark.sparkContext.addPyFile(to)


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings that tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lectern")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.warehouse.dir", os.environ.get("LECTERN_WAREHOUSE", "/tmp/lectern-warehouse"))
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` of the data set in `sf_dir`."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
