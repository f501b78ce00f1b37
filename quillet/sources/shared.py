"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new folder's path under ``spark.checkpoint.dir``. Where that is unset, under a temporary
    folder, on a local master only: executors elsewhere would not see it."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{named or tempfile.mkdtemp(prefix='quillet-')}/{name}-{uuid.uuid4().hex}"


_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(rows: DataFrame) -> DataFrame:
    """The rows, written in the shared folder and read again: their lineage ends here, and the shuffle files they were made from go."""
    spark, path = rows.sparkSession, folder(rows.sparkSession, "cut")
    before = spark.conf.get(_CLEAN_UP, "false")
    spark.conf.set(_CLEAN_UP, "true")
    try:
        rows.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN_UP, before)
    return spark.read.schema(rows.schema).parquet(path)


def drop(*cuts: DataFrame) -> None:
    """What :func:`cut` wrote goes; nothing that is still to run may read it."""
    for rows in cuts:
        for folder_ in {f.rsplit("/", 1)[0] for f in rows.inputFiles()}:
            path = rows.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(folder_)
            path.getFileSystem(rows.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
