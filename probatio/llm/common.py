"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space (fixed value of the result contracts).
WORD = r"[^\x20\x09-\x0D]+"


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32(doc_id as text) mod folds; a null id counts as the empty text, so its fold is 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def checkpoint_folder(spark) -> str:
    """spark.checkpoint.dir of the session; where that is unset, a temporary folder if everything runs in one JVM.

    On a cluster a folder of one machine is of no use to the others, so there an unset folder is an error.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context._jsc.sc().isLocal():
            raise RuntimeError("spark.checkpoint.dir is unset: name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints"))
    return context._jsc.sc().getCheckpointDir().get()


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or ``name`` with as many underscores as it takes to be none of the columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def hot_keys(many: DataFrame, key: str) -> list:
    """Keys that hold more than 1/256 of the rows, fewer than 256 whatever the data. One pass, nothing is shuffled.

    Counted by a sketch of frequent items that is exact up to far more items than can be hot; one that is reported
    although it is a little below the bound does no harm.
    """
    n, top = many.agg(F.count(key), F.expr(f"approx_top_k(`{key}`, 255, 10000)")).first()
    return [row["item"] for row in top or [] if row["item"] is not None and row["count"] * 256 > n]


def meet(many: DataFrame, one: DataFrame, key: str, other: str, hot: list) -> DataFrame:
    """``many`` joined on ``key`` with the one row of ``one`` that has it as ``other``, safe from hot keys.

    The rows of ``one`` for the hot keys are broadcast (fewer than 256), so the many rows that hold them stay where
    they are; all other rows are shuffled.
    """
    if not hot:
        return many.join(one, F.col(key) == F.col(other))
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    near = many.where(is_hot).join(F.broadcast(one.where(F.col(other).isin(hot))), F.col(key) == F.col(other))
    return near.unionByName(many.where(~is_hot).join(one.where(~F.col(other).isin(hot)), F.col(key) == F.col(other)))


def remove_folder(spark, folder: str) -> None:
    """Delete a folder that this session wrote, wherever Spark's file system keeps it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()
