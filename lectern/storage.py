"""Tables in the folder that driver and executors share.

Iterative operators cut their lineage by writing a table and reading it back, so
a lost executor costs a read and not a rebuild of every earlier round.
"""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.session import ship


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset, one of our own if all runs in one process, else none will do."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='lectern-')}"
        spark.sparkContext.setCheckpointDir(base)
        base = spark.sparkContext.getCheckpointDir()
    return base


def clean(spark: SparkSession) -> None:
    """Deletes the tables of all operator runs so far, whose results must have been written; also done when Python ends."""
    _Tables.of(spark).clear()


class _Tables:
    """The folders that an application has written tables to."""

    _known: dict[str, "_Tables"] = {}

    @classmethod
    def of(cls, spark: SparkSession) -> "_Tables":
        app = spark.sparkContext.applicationId
        if app not in cls._known:
            cls._known[app] = cls(spark)
            atexit.register(cls._known[app].clear)
        return cls._known[app]

    def __init__(self, spark: SparkSession):
        self.spark, self.roots = spark, []

    def clear(self) -> None:
        while self.roots:
            root = self.roots.pop()
            with contextlib.suppress(Exception):  # the session may have ended
                path = self.spark._jvm.org.apache.hadoop.fs.Path(root)
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """df for a join: broadcast if it has at most so many rows, which are counted, else sorted and merged."""
    return F.broadcast(df) if df.count() <= most else df.hint("merge")


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores until no column of df is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


class Scratch:
    """Named tables of one operator run."""

    def __init__(self, spark: SparkSession, tag: str):
        ship(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/lectern/{tag}-{uuid.uuid4().hex}"
        _Tables.of(spark).roots.append(self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df and returns it as read from the shared folder."""
        df.write.parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Deletes tables that no later step reads."""
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(conf).delete(path, True)
