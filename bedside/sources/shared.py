"""Relations written to the folder that all executors share."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def materialize(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write a derived relation, replacing an earlier one, and return the scan of the written files.

    Later steps then start from files that outlive a lost executor, and their lineage ends here.
    """
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keep_in(folder: str):
    """A ``keep(name, frame)`` that materializes under a fresh subfolder of ``folder``, which goes when the driver ends."""
    run = f"{folder.rstrip('/')}/{uuid.uuid4().hex}"

    def keep(name: str, df: DataFrame) -> DataFrame:
        atexit.register(_remove, df.sparkSession, run)
        return materialize(df, f"{run}/{name}")

    return keep


def _remove(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    if context._jsc is None or context._jvm is None:
        return
    try:
        place = context._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)
    except Exception:  # the session may be ending; a leftover folder does no harm
        return


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, else the context's checkpoint folder, else the warehouse.

    On a cluster the warehouse may be a folder of the driver's machine alone, which is refused.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    if not spark.sparkContext.master.startswith("local") and (folder.startswith("file:") or "://" not in folder):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder


def passing_folder(spark: SparkSession, name: str) -> str:
    """A subfolder of the shared one that goes when the driver ends."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}"
    atexit.register(_remove, spark, path)
    return path
