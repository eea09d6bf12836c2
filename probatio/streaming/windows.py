"""Findings as a stream: counts in tumbling windows, and files that were seen before."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, a temporary one if everything runs in one JVM."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext._jsc.sc().isLocal():
        raise RuntimeError("spark.checkpoint.dir is unset: name a folder that all executors share")
    return folder or tempfile.mkdtemp(prefix="streams")


def flag_windows(events: DataFrame, width: str = "1 day", delay: str = "1 hour", time: str = "ts", kind: str = "event_type") -> DataFrame:
    """window_start, kind, n: events in each closed window. State is one row for each open window and kind.

    Events later than ``delay`` behind the newest one are left out of windows that are already written.
    """
    counted = events.withWatermark(time, delay).groupBy(F.window(time, width).alias("w"), F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), "kind", "n")


def first_seen(files: DataFrame, delay: str = "1 day", key: str = "file_hash", time: str = "ts") -> DataFrame:
    """The first arrival of each file within the delay; state is one row for each hash in it."""
    return files.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def drain(stream: DataFrame) -> DataFrame:
    """What a stream has to say of the input that is there now, written once as Parquet and read back."""
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/rows")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def score_files(files: DataFrame, score: Callable[[DataFrame], DataFrame], folder: str) -> DataFrame:
    """Score a stream of files, a batch at a time, and give all scores written so far.

    ``score`` maps a batch of files to rows; a batch is written to a folder of its own name, so one that is run again
    after a failure replaces what it wrote and no file counts twice.
    """
    spark = files.sparkSession
    rows = f"{folder}/rows"

    def write(batch: DataFrame, number: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{rows}/batch={number}")

    query = files.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.option("basePath", rows).parquet(rows).drop("batch")
