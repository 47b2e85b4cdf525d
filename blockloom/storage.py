"""Tables written on the way, in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset, as in tests, a temporary folder serves
    in local mode; on a cluster that is an error, since executors don't share their disks."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="blockloom-shared-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def _home(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/blockloom/{spark.conf.get('spark.app.id', 'app')}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet and read it back: the lineage is cut at a point that
    outlives any executor, and several consumers share costly columns."""
    path = f"{_home(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Deletes what this application has written on the way. For its end: results that
    haven't been written elsewhere can't be read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_home(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
