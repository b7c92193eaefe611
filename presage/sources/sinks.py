"""Sinks: CSV, JSON reports, folders of filings, tables with full refresh and resumed appends."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, StructType

from presage.operators.joins import resume
from presage.sources.connector import _system

#: Filings, and bytes of their texts, that a folder holds on average.
FOLDER_ROWS, FOLDER_BYTES = 4096, 64 << 20


def rounded(df: DataFrame, digits: int = 4, half_even: bool = False) -> DataFrame:
    """Doubles to `digits` places, those in structs and arrays too; for reports only. half_even: ties go to the even digit."""
    to = F.bround if half_even else F.round

    def inside(x: Column, kind: DataType) -> Column:
        if isinstance(kind, (DoubleType, FloatType)):
            return to(x, digits)
        if isinstance(kind, ArrayType):
            return F.transform(x, lambda e: inside(e, kind.elementType))
        if isinstance(kind, StructType):
            return F.when(x.isNotNull(), F.struct(*[inside(x[f.name], f.dataType).alias(f.name) for f in kind.fields]))
        return x

    return df.select(*[inside(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def json_rows(df: DataFrame, out: str = "json", whole: list[str] | None = None) -> DataFrame:
    """A JSON object for each row; nulls and NaN are left out; the columns of `whole` are integers."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (DoubleType, FloatType))]
    clean = df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df
    clean = clean.withColumns({c: F.col(c).cast("bigint") for c in whole}) if whole else clean
    return clean.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "true"}).alias(out))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str, digits: int = 4) -> None:
    rounded(df, digits).write.mode("overwrite").json(path)


def refresh(df: DataFrame, path: str) -> None:
    """Full refresh: what was there goes."""
    df.write.mode("overwrite").parquet(path)


def refresh_table(df: DataFrame, name: str, path: str) -> None:
    """Full refresh of a named table: its rows are written whole at a new path, and then the name points there.

    A name that is there is pointed elsewhere in one step of the catalog, so readers
    find either the old rows or the new ones, and never none.
    """
    spark = df.sparkSession
    df.write.parquet(path)
    if spark.catalog.tableExists(name):
        spark.sql(f"ALTER TABLE {name} SET LOCATION '{path}'")
        spark.catalog.refreshTable(name)
    else:
        spark.catalog.createTable(name, path=path, source="parquet", schema=df.schema)


def insert_rows(df: DataFrame, name: str) -> None:
    """Appends rows to a named table."""
    df.write.insertInto(name)


def drop_table(spark: SparkSession, name: str) -> None:
    """The name goes; it need not be there. Its files stay in the shared folder until that goes."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def append_new(df: DataFrame, path: str, keys: list[str]) -> None:
    """Appends the rows whose keys the table lacks."""
    done = df.sparkSession.read.schema(df.schema).parquet(path)
    resume(df, done, keys).select(*df.columns).write.mode("append").parquet(path)


def write_filings(df: DataFrame, path: str, rows: int = FOLDER_ROWS, size: int = FOLDER_BYTES) -> None:
    """(ticker, form, filed, accession, text) as folders below path, each of about `rows` filings and at most about `size` bytes of text.

    A folder's metadata.json is an array of the filings' objects, its text.txt their
    texts one behind another. A task that is repeated writes the same files again.
    """
    found = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    folders = max(1, -(-found["n"] // rows), -(-found["bytes"] // size))

    def write(table: pa.Table) -> pa.Table:
        system, base = _system(path)
        own = f"{base}/{table['_folder'][0].as_py():08d}"
        said, texts, at = [], [], 0
        for r in table.drop_columns("_folder").sort_by([(c, "ascending") for c in names]).to_pylist():
            text = r.pop("text")
            raw = (text or "").encode()
            said.append({k: v for k, v in (r | {"start": at, "size": None if text is None else len(raw)}).items() if v is not None})
            texts.append(raw)
            at += len(raw)
        system.create_dir(own, recursive=True)
        for name, content in (("text.txt", b"".join(texts)), ("metadata.json", json.dumps(said).encode())):
            with system.open_output_stream(f"{own}/{name}") as f:
                f.write(content)
        return pa.table({"n": pa.array([len(said)], pa.int64())})

    names = ["accession", "ticker", "form", "filed", "text"]
    dealt = df.select(*names, F.pmod(F.xxhash64("accession", "ticker", "form", "filed"), F.lit(folders)).alias("_folder"))
    dealt.groupBy("_folder").applyInArrow(write, "n bigint").collect()


def pending(spark: SparkSession, schema: str, missing: list[str] | None = None) -> DataFrame:
    """The report of a stage whose inputs are absent: a row that is marked pending and names them, its other columns null."""
    named = spark.createDataFrame([(True, ",".join(missing or []))], "_pending boolean, _missing string")
    empty = spark.createDataFrame([], schema)
    return named.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in empty.schema.fields], "_pending", "_missing")


def meta(df: DataFrame, vintage: str, graded: Column, outcome: Column) -> DataFrame:
    """One row: counts, and the sorted vintages, those with outcomes and those without."""
    out = df.agg(
        F.count("*").alias("n"), F.count(F.when(graded, 1)).alias("graded"), F.count(outcome).alias("with_outcome"),
        F.array_sort(F.collect_set(vintage)).alias("v"), F.array_sort(F.collect_set(F.when(outcome.isNotNull(), F.col(vintage)))).alias("o"),
    )
    text = lambda a: F.array_join(a, ",")
    return out.select("n", "graded", "with_outcome", text("v").alias("vintages"), text("o").alias("outcome_vintages"), text(F.array_except("v", "o")).alias("forecast_vintages"))
