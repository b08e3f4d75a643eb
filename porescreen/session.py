"""Session helpers: lineage cuts that survive the loss of executors."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session; a temporary one only where none is set and all runs in one process.

    On a cluster every executor would write to its own disk, so there the folder must be set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        active = spark.sparkContext._jsc.sc().getCheckpointDir()
        if active.isDefined():
            folder = active.get()
        elif re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            folder = tempfile.mkdtemp(prefix="spark-")
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the written copy."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the files, for loops that join what the round before returned.

    A checkpoint keeps Spark's estimate of the size of its rows, which for a join is the product of its sides. In such a
    loop the digits of the estimate multiply in every round, until the driver's memory is full of them; files have the
    size they have. The files stay as long as the folder does, so the tables are small ones."""
    out = f"{shared_folder(df.sparkSession)}/written-{uuid.uuid4()}"
    df.write.parquet(out)
    return df.sparkSession.read.schema(df.schema).parquet(out)
