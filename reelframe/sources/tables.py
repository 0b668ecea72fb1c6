"""Folders for tables that are written and read again."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder below the one that spark.checkpoint.dir names, which goes when the driver ends.

    Where nothing is set, a local folder does in local mode, as in tests; on a cluster that is an error, as executors
    would not see each other's files."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    path = f"{sc.getCheckpointDir()}/{uuid.uuid4().hex}"
    place = sc._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def hold(df: DataFrame) -> DataFrame:
    """The rows as a table written in such a folder, which cuts the lineage. Columnar files are a fraction of the size
    of checkpoint()'s."""
    path = folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
