"""Helpers shared by the operators: words, table access, and relations written to the shared folder."""

from __future__ import annotations

import atexit
import re
import uuid
from contextlib import contextmanager
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bedside.sources.shared import shared_folder

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes in an Arrow batch (about): a batch is held by the executor and, copied, by its worker.
BATCH_BYTES = 4_000_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(wanted: str, taken) -> str:
    """``wanted``, with underscores added until no column in ``taken`` has that name (case apart)."""
    used = {c.lower() for c in taken}
    while wanted.lower() in used:
        wanted += "_"
    return wanted


@contextmanager
def small_batches(spark: SparkSession, size: int = BATCH_BYTES):
    """Arrow batches of about ``size`` bytes for the jobs inside; a lower setting stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    number, unit = re.fullmatch(r"(-?\d+)\s*([kmgt]?)b?", (before or "-1").lower()).groups()
    now = int(number) * 1024 ** " kmgt".index(unit or " ")
    spark.conf.set(name, str(min(size, now) if now > 0 else size))
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


class Scratch:
    """Relations written under the folder that all executors share, so that lineage ends at files which outlive them.

    The folder is ``spark.checkpoint.dir``, else the context's checkpoint folder, else the warehouse. ``drop`` deletes a
    relation that no later step reads; what is left goes when the driver ends. Off local mode a warehouse on the driver's
    machine is refused.
    """

    def __init__(self, spark: SparkSession):
        base = shared_folder(spark)
        self.spark = spark
        self.folder = f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"
        self.latest: dict[str, str] = {}
        self.number = count()
        atexit.register(self._delete, self.folder)

    def keep(self, df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
        """A relation read back from files of its own; a second one of that name leaves the first alone."""
        path = self.latest[name] = f"{self.folder}/{name}-{next(self.number)}"
        df.write.mode("overwrite").option("compression", "zstd").partitionBy(*partition_by).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(self.latest.pop(name))

    def _delete(self, path: str) -> None:
        context = self.spark.sparkContext
        if context._jsc is None or context._jvm is None:
            return
        try:
            place = context._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)
        except Exception:  # the session may be ending; a leftover folder does no harm
            return
