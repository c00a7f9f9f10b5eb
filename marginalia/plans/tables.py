"""Tables that cut a lineage: written once into the folder that the cluster shares, and read back.

They live as long as a result that reads them may be asked for; `drop_written` deletes those
that this driver has written, once its results are stored elsewhere.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset on one machine (tests), one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = known.get() if known.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="marginalia-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, from a table: what uses them twice doesn't make them twice."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession) -> int:
    """Delete the tables that this driver has written so far, and say how many; results that read them can't be made again."""
    sc, n = spark.sparkContext, 0
    while _written:
        path = sc._jvm.org.apache.hadoop.fs.Path(_written.pop())
        n += bool(path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True))
    return n
