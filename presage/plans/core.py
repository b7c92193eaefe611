"""The registry's decorator, and the frames that the registered queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presage.functions.text import fold_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query (spark, sf_dir) -> DataFrame, with the SQL that must give the same rows."""

    def add(run):
        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = sql
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Ordinal classes of the stand-in target, best first.
CLASSES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
FEATURES = ["segment", "status", "region", "size"]
FOLDS = [0, 1, 2, 3, 4]

#: Orders as graded companies: a row for each (ticker, vintage) observation, some segments missing.
FIRMS_SQL = """
firms as (
  select o_orderkey as id, cast(o_custkey as varchar) as ticker, cast(year(o_orderdate) as int) as vintage,
    o_orderpriority as cls, cast(substr(o_orderpriority, 1, 1) as int) - 1 as rank,
    case when o_orderkey % 11 = 0 then null else c_mktsegment end as segment,
    o_orderstatus as status, r_name as region, n_name as nation,
    case when o_totalprice < 150000 then 'small' when o_totalprice < 300000 then 'medium' else 'large' end as size,
    o_totalprice as price, c_acctbal as balance, o_orderdate as ts,
    cast(list_sum(list_transform(string_split(md5(cast(o_custkey as varchar)), ''), lambda c: cast(concat('0x', c) as int))) % 5 as int) as fold
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
)"""


def firms(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    df = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    df = df.join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    ticker, price = F.col("o_custkey").cast("string"), F.col("o_totalprice")
    return df.select(
        F.col("o_orderkey").alias("id"), ticker.alias("ticker"), F.year("o_orderdate").alias("vintage"), F.col("o_orderpriority").alias("cls"),
        (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("rank"),
        F.when(F.col("o_orderkey") % 11 != 0, F.col("c_mktsegment")).alias("segment"), F.col("o_orderstatus").alias("status"), F.col("r_name").alias("region"),
        F.col("n_name").alias("nation"), F.when(price < 150000, "small").when(price < 300000, "medium").otherwise("large").alias("size"),
        price.alias("price"), F.col("c_acctbal").alias("balance"), F.col("o_orderdate").alias("ts"), fold_of(ticker).cast("int").alias("fold"),
    )


#: The features of a row as (id, fold, cls, field, value), missing values a category.
LONG_SQL = """
u as (
  select id, fold, cls, rank, 'segment' as field, coalesce(segment, '(missing)') as value from firms
  union all select id, fold, cls, rank, 'status', status from firms
  union all select id, fold, cls, rank, 'region', region from firms
  union all select id, fold, cls, rank, 'size', size from firms
)"""

#: The same without missing values.
PRESENT_SQL = LONG_SQL.replace("coalesce(segment, '(missing)') as value from firms", "segment as value from firms where segment is not null")


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as price rows: (key, ts, close, theme, event_id)."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("key"), "ts", (F.col("value") + 0.0).alias("close"), F.col("event_type").alias("theme"), "event_id")


PRICES_SQL = "prices as (select user_id as key, ts, value + 0.0 as close, event_type as theme, event_id from events)"
