"""Unfinished tasks are taken up again: each is worked off once, however often the stream stops and starts.

The stream's checkpoint tells which tasks were read, keyed state on disk which were seen before, and a batch's results are written
under the batch's number. A stream that stops after the write and before the commit runs the same batch again, which puts the same
results in the place of those that are there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from .sessions import keyed_state

#: States of tasks that are taken up, and what they end as.
UNFINISHED, DONE, FAILED = ("pending", "processing"), "completed", "failed"
NO_PATH = "the task has no file path"


def write_batch(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").parquet(path)


def take_up(tasks: DataFrame, work: Callable[[DataFrame], DataFrame], results: str, checkpoint: str, key: str = "task_id", path_col: str = "file_path", status_col: str = "status") -> StreamingQuery:
    """Starts a stream that works off what tasks (a stream) has unfinished, until there is no more; results: a folder.

    work gets a batch of tasks that have a path and gives one row for each: the key and the columns of its result. A task without a path
    ends failed. A task that comes again, in this run or a later one, isn't worked off again.
    """
    spark = tasks.sparkSession
    unfinished = tasks.where(F.col(status_col).isin(*UNFINISHED)).dropDuplicates([key])
    has_path = F.coalesce(F.trim(F.col(path_col)), F.lit("")) != ""

    def step(batch: DataFrame, n: int) -> None:
        done = work(batch.where(has_path)).withColumns({"status": F.lit(DONE), "message": F.lit(None).cast("string")})
        lost = batch.where(~has_path).select(key, F.lit(FAILED).alias("status"), F.lit(NO_PATH).alias("message"))
        write_batch(done.unionByName(lost, allowMissingColumns=True), f"{results}/batch={n}")

    with keyed_state(spark):
        return unfinished.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def results_of(spark: SparkSession, results: str, schema: T.StructType | str) -> DataFrame:
    """All results that were written."""
    return spark.read.schema(schema).parquet(f"{results}/batch=*")
