"""Tables that a job writes for itself, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _own_dir(application: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix="sqlcurio-")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path below ``spark.checkpoint.dir``, else below the folder of setCheckpointDir(); deleted when the JVM ends.

    A temporary folder serves a local master that names none; a cluster must name one.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        folder = _own_dir(context.applicationId)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{label}-{uuid.uuid4().hex}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return path.toString()


def written(df: DataFrame, label: str) -> DataFrame:
    """df, written once and read back: lineage ends here, and lost executors lose nothing."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df's rows dealt evenly over as many tasks as a shuffle has.

    For narrow rows whose analysis costs far more than reading them: a few megabytes of file are one task.
    The number is given, as small partitions would be put together again otherwise.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
