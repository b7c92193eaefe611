"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Application folders that are marked for deletion.
_KEPT: set[str] = set()


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def shared_folder(spark: SparkSession) -> str:
    """The application's folder where all executors share files, under ``spark.checkpoint.dir``.

    What lies in it is needed until the results are read, so it is deleted when
    the driver's JVM ends. Where the setting is absent a local session gets a
    temporary folder; on a cluster that would be wrong without notice, so it is
    an error there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="presage-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        base = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", base)
    own = f"{base.rstrip('/')}/{spark.sparkContext.applicationId}"
    if own not in _KEPT:
        _KEPT.add(own)
        system, target = _file_system(spark, own)
        system.mkdirs(target)
        system.deleteOnExit(target)
    return own


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    Unlike checkpoint(), which runs the plan once to count and once to save,
    this computes df once, and the copy survives lost executors.
    """
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local_rows(spark: SparkSession, rows: list[tuple], kinds: dict[str, pa.DataType]) -> DataFrame:
    """Rows of the driver, in their order, as a relation whose size the optimizer knows; projections of it run no job."""
    columns = list(zip(*rows)) or [()] * len(kinds)
    return spark.createDataFrame(pa.table({name: pa.array(x, kind) for (name, kind), x in zip(kinds.items(), columns)}))


def one_row(spark: SparkSession) -> DataFrame:
    """A single row, to evaluate stated values on the driver."""
    return local_rows(spark, [(0,)], {"_": pa.int32()})


def remove_path(spark: SparkSession, path: str) -> None:
    system, target = _file_system(spark, path)
    system.delete(target, True)
