"""Work that is dealt out by rows: a key of eight bytes may stand for a file or an image that takes milliseconds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

#: Partitions for each core at least, so that the last ones to end are short.
WAVES = 4
#: Most bytes of drawn values that a Python worker holds at a time, and values that it judges at a time.
HELD, JUDGED = 4 << 20, 64
#: Most bytes of a batch that goes to a Python worker; the engine's own bound of 64 MB is held several times a task.
BATCH = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on batches of this session hold BATCH bytes at most."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(spark.conf.get(name).rstrip("bB"))
    if not 0 < now <= BATCH:
        spark.conf.set(name, str(BATCH))


def spread(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows dealt out by key to all cores.

    A reader splits tables by their bytes: a million keys are one small file and so one task, however long each takes.
    """
    spark = rows.sparkSession
    parts = max(WAVES * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(parts, key)


def portions(rows: pd.DataFrame, size: int) -> Iterator[pd.DataFrame]:
    """The rows a few at a time, so that what is made of them, ``size`` bytes each, stays below HELD."""
    step = max(1, HELD // max(1, size))
    for start in range(0, len(rows), step):
        yield rows.iloc[start : start + step]


def each(find: Callable, kind: str, values: Column) -> Column:
    """What ``find`` says of each of the values, null as None; of type ``kind``.

    Files and images are large: a batch stays as it came, and values leave it, and findings the worker, a few at a time.
    """
    small_batches(SparkSession.active())
    type_ = to_arrow_type(_parse_datatype_string(kind))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for start in range(0, len(batch), JUDGED):
                yield pa.array([find(value.as_py()) for value in batch.slice(start, JUDGED)], type_)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, kind)(values)
