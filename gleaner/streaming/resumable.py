"""Stages that can be stopped and started again: files of items are worked through once, batch by batch.

This goes beyond filtering finished items: the list of files that are done is the stream's checkpoint, so a
start that follows a stop, a lost driver or newly arrived files goes on with what is left.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH = "_batch"


def run(spark: SparkSession, items: str, schema: str, work: Callable[[DataFrame], DataFrame], path: str, key: Sequence[str], files_per_batch: int = 1000) -> DataFrame:
    """The results of work(items) for every key once; items are Parquet files in a folder, results and checkpoint lie below path.

    work takes and returns a DataFrame and must keep the key columns; it is given each key that no earlier batch
    has finished, one row of it (of rows that share a key in a batch any one, equal rows being the case meant).
    A batch is one folder, named by its number and overwritten when a batch is repeated after a stop, so no
    result is published twice. Null keys are equal to each other. Without files nothing is written and the result
    has no rows and the columns of work. An error of work ends the run; batches before it stay.
    """
    done = f"{path}/results"

    def publish(batch: DataFrame, number: int) -> None:
        fresh = batch.dropDuplicates(list(key))
        if number:
            finished = spark.read.parquet(done).where(F.col(BATCH) < number).select(*[F.col(k).alias(f"_done_{i}") for i, k in enumerate(key)])  # only keys are read, and no folder that this batch left behind
            same = [F.col(k).eqNullSafe(F.col(f"_done_{i}")) for i, k in enumerate(key)]
            fresh = fresh.join(finished, same, "left_anti")
        work(fresh).write.mode("overwrite").parquet(f"{done}/{BATCH}={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(items)
    query = stream.writeStream.foreachBatch(publish).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return results(spark, path, work(spark.createDataFrame([], schema)))


def results(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """What is published below path, without batch numbers; like gives the columns.

    A batch that was stopped while it was written has no _SUCCESS mark yet and is left out.
    """
    jvm = spark.sparkContext._jvm
    found = jvm.org.apache.hadoop.fs.Path(f"{path}/results/{BATCH}=*/_SUCCESS")
    marks = found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(found) or []
    folders = [m.getPath().getParent().toString() for m in marks]
    return spark.read.schema(like.schema).parquet(*folders) if folders else spark.createDataFrame([], like.schema)
