"""Uploads as a stream of files, jobs as micro-batches, progress as the last event."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.operators import library, reviews
from lectern.storage import Scratch

#: What Spark says when not the job but the cluster has failed.
LOST = re.compile("ExecutorLostFailure|FetchFailed|Executor heartbeat timed out|Slave lost|worker lost|No space left on device|Cannot call methods on a stopped")
BINARY = "path string, modificationTime timestamp, length long, content binary"


def uploads(spark: SparkSession, folder: str, *, suffix: str = ".pdf", per_batch: int = 64) -> DataFrame:
    """job_id, path, doc_hash, content, uploaded_at of the files that land in a folder; other suffixes are ignored."""
    return _jobs(spark.readStream.format("binaryFile").schema(BINARY).option("maxFilesPerTrigger", per_batch).load(folder), suffix)


def _jobs(files: DataFrame, suffix: str) -> DataFrame:
    files = files.where(F.lower("path").endswith(suffix))
    return files.select(F.sha2(F.concat("path", F.col("length").cast("string")), 256).substr(1, 16).alias("job_id"), "path", library.content_hash(F.col("content")).alias("doc_hash"), "content", F.col("modificationTime").alias("uploaded_at"))


def run_jobs(stream: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, *, once: bool = False) -> StreamingQuery:
    """Applies work to every micro-batch and appends its rows, and a status row for each job, below `out`.

    Jobs that can't be done end in an error. Where the cluster fails (a lost executor, a fetch that failed), the stream
    stops instead: started again, it runs the batch again from the checkpoint and overwrites its folder.
    """

    writer = stream.writeStream.foreachBatch(lambda batch, n: _done(batch, n, work, out)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def _done(batch: DataFrame, n: int, work: Callable[[DataFrame], DataFrame], out: str) -> None:
    jobs = batch.select("job_id", "path", "doc_hash").distinct()
    try:
        work(batch).write.mode("overwrite").parquet(f"{out}/results/batch={n}")
        status = jobs.withColumns({"status": F.lit("done"), "error": F.lit(None).cast("string")})
    except Exception as e:  # the jobs of a batch that can't be done say so, the stream goes on
        if LOST.search(str(e)):
            raise
        status = jobs.withColumns({"status": F.lit("error"), "error": F.lit(f"{type(e).__name__}: {str(e)[:500]}")})
    status.withColumn("at", F.current_timestamp()).write.mode("overwrite").parquet(f"{out}/status/batch={n}")


def resume_jobs(spark: SparkSession, folder: str, work: Callable[[DataFrame], DataFrame], out: str, *, suffix: str = ".pdf") -> None:
    """Runs the jobs that ended in an error again, as one more batch beyond those of the stream."""
    again = resumable(statuses(spark, out)).select("job_id")
    files = _jobs(spark.read.format("binaryFile").load(folder), suffix).join(again, "job_id", "left_semi")
    last = spark.read.parquet(f"{out}/status").agg(F.max("batch")).first()[0]
    _done(Scratch(spark, "resume").save(files, "files"), max(last + 1, 1 << 30), work, out)


def statuses(spark: SparkSession, out: str) -> DataFrame:
    """job_id, path, status, error: the last word on each job."""
    rows = spark.read.parquet(f"{out}/status")
    return reviews.latest_progress(rows, "job_id", order=["at", "batch"], fields=["path", "status", "error"])


def resumable(jobs: DataFrame) -> DataFrame:
    """Jobs that may run again: only those that ended in an error."""
    return jobs.where("status = 'error'")


def progress(events: DataFrame) -> DataFrame:
    """job_id, stage, completed, total: the last event of each stage, for batches and streams alike."""
    last = events.groupBy("job_id", "stage").agg(F.max_by(F.struct("completed", "total"), F.struct("ts", "event_id")).alias("x"))
    return last.select("job_id", "stage", "x.completed", "x.total")
