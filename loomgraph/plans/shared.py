"""Tables cut out of their lineage, kept in the folder that the whole cluster shares.

``spark.checkpoint.dir`` names that folder and is read from the session. Only
where the session has none (tests on one machine) is a folder of our own set.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder, set to a fresh one only where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet in the shared folder; the table read back, and its path."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def forget(spark: SparkSession, path: str) -> None:
    """Delete a table made by :func:`written` that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of plans that nothing refers to any more, such as those behind written tables; else they stay until the driver's heap fills."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
