"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from presage.operators.staging import materialize, new_path, remove_path, shared_folder

__all__ = ["ASCII_LOWER", "crc_mod", "materialize", "new_path", "release", "remove_path", "shared_folder", "table"]

#: A-Z to a-z on bytes; other bytes stay.
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of the column as text, modulo modulus; a null counts as ''."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % modulus


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release() -> None:
    """Gives back to the system what a task has freed: its worker lives on, and its memory counts as the executor's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
    if trim:
        trim(0)
