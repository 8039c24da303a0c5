"""Staging tables: cut lineage by writing a table to the folder that all executors share."""

from __future__ import annotations

import functools
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

#: Shuffle files of a write are of no use once it has ended: what follows reads the table.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


@functools.cache
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="attestra-")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; one of our own where that is unset, on a single machine only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (named or _own_dir()).rstrip("/")


def staged(df: DataFrame) -> DataFrame:
    """`df`, written once as Parquet to the shared folder and read again.

    Unlike checkpoint() the plan runs once, not twice, and the files survive the loss of any executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/attestra-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN, "false")
    spark.conf.set(CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def spent(*tables: DataFrame) -> None:
    """Deletes tables that `staged` returned, once all that reads them has been written itself."""
    for table in tables:
        if path := _PATHS.pop(table, None):
            spark = table.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def in_groups(rows: int, per_group: int) -> int:
    """How many groups of about `per_group` rows hold `rows` rows; at least one."""
    return max(1, -(-rows // per_group))
