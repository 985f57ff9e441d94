"""Materialized intermediate tables that survive the loss of executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL_FOLDERS: dict[str, str] = {}
_OWNERS: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder.

    Only where driver and executors are one process may it be unset: the session then gets a folder
    that goes when the process ends.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="perennial-")
        atexit.register(shutil.rmtree, _LOCAL_FOLDERS[app], ignore_errors=True)
    return _LOCAL_FOLDERS[app]


def materialize(
    df: DataFrame, name: str = "table", partition_by: tuple[str, ...] = (), **options
) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder, with options of the writer, and read it back.

    Cuts the lineage like ``checkpoint()`` but keeps column pruning and filter pushdown for the
    plans that read it.  Runs one job.  Inside ``owned_tables`` the table belongs to that block.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/perennial/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).partitionBy(*partition_by).parquet(path)
    if _OWNERS:
        _OWNERS[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def owned_tables(spark: SparkSession) -> Iterator[None]:
    """Removes, at its end, the tables that were materialized inside; use up results before."""
    _OWNERS.append([])
    try:
        yield
    finally:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in _OWNERS.pop():
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)
