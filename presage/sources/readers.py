"""Sources: CSV, nested JSON, columnar JSON, HTML tables, price history. Schemas are given, never inferred."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presage.functions.text import html_to_text

#: Company facts: concept -> unit -> points.
FACTS = (
    "struct<facts: struct<`us-gaap`: map<string, struct<units: map<string, "
    "array<struct<start: string, `end`: string, val: double, filed: string, form: string, fp: string>>>>>>>"
)
TICKERS = "map<string, struct<cik_str: bigint, ticker: string, title: string>>"
SUBMISSIONS = (
    "struct<filings: struct<recent: struct<form: array<string>, filingDate: array<string>, reportDate: array<string>, "
    "accessionNumber: array<string>, primaryDocument: array<string>, items: array<string>>, files: array<struct<name: string>>>>"
)
#: A further page of submissions: the parallel arrays by themselves.
PAGE = SUBMISSIONS[SUBMISSIONS.index("recent: ") + 8 : SUBMISSIONS.index(", files")]
#: What a filing's folder says of it; start and size are given where the folder holds several.
METADATA = "struct<ticker: string, form: string, filed: string, accession: string, start: bigint, size: bigint>"


class Source(Protocol):
    """Anything that yields a table: Parquet and Csv below, or a caller's own."""

    def read(self, spark: SparkSession) -> DataFrame: ...


def csv(spark: SparkSession, path: str, schema: str, comment: str | None = None, header: bool = True) -> DataFrame:
    """A CSV, with a header or without; lines that begin with `comment` are skipped; NaN and empty fields are null."""
    reader = spark.read.schema(schema).option("header", header).option("nanValue", "NaN" if not header else "nan")
    df = (reader.option("comment", comment) if comment else reader).csv(path)
    floats = [f.name for f in df.schema.fields if f.dataType.simpleString() in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, json): whole files."""
    return spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("path"), F.col("value").alias("json"))


def company_facts(docs: DataFrame, key: str = "path", json: str = "json") -> DataFrame:
    """(key, concept, unit, start, end, val, filed, form, fp): a row for each reported point."""
    parsed = docs.select(key, F.from_json(json, FACTS).alias("j"))
    concepts = parsed.select(key, F.explode("j.facts.us-gaap").alias("concept", "c"))
    units = concepts.select(key, "concept", F.explode("c.units").alias("unit", "points"))
    points = units.select(key, "concept", "unit", F.explode("points").alias("p"))
    date = lambda c: F.try_to_date(F.col(f"p.{c}"), "yyyy-MM-dd").alias(c)
    return points.select(key, "concept", "unit", date("start"), date("end"), "p.val", date("filed"), "p.form", "p.fp")


def ticker_index(docs: DataFrame, json: str = "json") -> DataFrame:
    """(ticker, cik, title)."""
    rows = docs.select(F.explode(F.map_values(F.from_json(json, TICKERS))).alias("t"))
    return rows.select(F.upper(F.trim("t.ticker")).alias("ticker"), F.col("t.cik_str").alias("cik"), "t.title")


def _filings(pages: DataFrame, key: str, arrays: str) -> DataFrame:
    names = ["form", "filingDate", "reportDate", "accessionNumber", "primaryDocument", "items"]
    zipped = pages.select(key, f"{arrays}.*").select(key, F.inline(F.arrays_zip(*names)))
    return zipped.withColumn("filed", F.try_to_date("filingDate", "yyyy-MM-dd"))


def submissions(docs: DataFrame, key: str = "path", json: str = "json", pages: DataFrame | None = None) -> DataFrame:
    """A row for each filing of columnar submission files.

    pages(name, json): the further files that a company's `filings.files` names;
    their filings are rows of that company too.
    """
    parsed = docs.select(key, F.from_json(json, SUBMISSIONS).alias("j")).select(key, F.col("j.filings.recent").alias("recent"), F.col("j.filings.files.name").alias("names"))
    out = _filings(parsed, key, "recent")
    if pages is None:
        return out
    named = parsed.select(key, F.explode("names").alias("name")).join(pages.select("name", F.from_json("json", PAGE).alias("page")), "name")
    return out.unionByName(_filings(named, key, "page"))


def filing_folders(spark: SparkSession, path: str) -> DataFrame:
    """(ticker, form, filed, accession, text): the folders below path, each with a metadata.json and a text.txt.

    metadata.json holds one filing's object, whose text is the whole of text.txt, or
    an array of many filings' objects, whose start and size are the bytes of
    text.txt that each has; one with a start and no size has no text.
    """
    whole = lambda name: spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).text(path, wholetext=True)
    folder = F.regexp_extract(F.input_file_name(), r"^(.*)/[^/]+$", 1).alias("folder")
    unread = F.array(F.lit(None).cast(METADATA))
    said = whole("metadata.json").select(folder, F.coalesce(F.from_json("value", f"array<{METADATA}>"), unread).alias("m"))
    texts = whole("text.txt").select(folder, F.col("value").alias("_text"), F.col("value").cast("binary").alias("_bytes"))
    part = lambda m: F.substring(F.col("_bytes"), (m["start"] + 1).cast("int"), m["size"].cast("int")).cast("string")
    own = F.transform("m", lambda m: F.struct(m.alias("m"), F.when(m["start"].isNull(), F.col("_text")).otherwise(part(m)).alias("text")))
    each = said.join(texts, "folder").select(F.explode(own).alias("f"))
    return each.select("f.m.ticker", "f.m.form", F.try_to_date("f.m.filed", "yyyy-MM-dd").alias("filed"), "f.m.accession", "f.text")


class Parquet:
    """A source of stored tables: folder/name.parquet."""

    def __init__(self, folder: str, name: str):
        self.folder, self.name = folder, name

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/{self.name}.parquet")


class Csv:
    """A source of CSV files under a given schema."""

    def __init__(self, path: str, schema: str, comment: str | None = None):
        self.path, self.schema, self.comment = path, schema, comment

    def read(self, spark: SparkSession) -> DataFrame:
        return csv(spark, self.path, self.schema, self.comment)


def html_tables(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """(key, table, row, cells): the cells' text of every table row."""
    tables = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(r"(?is)<table[^>]*>(.*?)</table>"), F.lit(1))).alias("table", "t"))
    rows = tables.select(key, "table", F.posexplode(F.regexp_extract_all("t", F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("row", "r"))
    strip = lambda c: F.regexp_replace(html_to_text(c), r"^\s+|\s+$", "")
    cells = F.transform(F.regexp_extract_all("r", F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), strip)
    return rows.select(key, "table", "row", cells.alias("cells"))


def history(prices: DataFrame, ts: str, since: object, until: object) -> DataFrame:
    """Price rows from since on and before until."""
    return prices.where((F.col(ts) >= F.lit(since)) & (F.col(ts) < F.lit(until)))


def read_through(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at path; made and written first if there is none."""
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def subset(df: DataFrame, key: str, keys: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Rows of the named keys, at most `limit` in key order: for looking at a part by hand."""
    out = df.where(F.col(key).isin(keys)) if keys else df
    return out.orderBy(key).limit(limit) if limit else out


def schema_of(df: DataFrame) -> list[tuple[str, str, bool]]:
    """(column, type, nullable)."""
    return [(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema.fields]
