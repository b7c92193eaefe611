"""Queries of joins, point-in-time lookups, membership and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from presage.operators import joins
from presage.plans.core import FIRMS_SQL, firms, query, table
from presage.sources import readers, sinks


def _orders(spark, sf_dir):
    """Orders as filings: (ticker, filed, end, form, val, id)."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_custkey").alias("ticker"), F.col("o_orderdate").cast("date").alias("filed"), F.date_sub(F.col("o_orderdate").cast("date"), 60).alias("end"),
        F.col("o_orderstatus").alias("form"), F.col("o_totalprice").alias("val"), F.col("o_orderkey").alias("id"),
    )


_FILINGS = """filings as (select o_custkey as ticker, cast(o_orderdate as date) as filed, cast(o_orderdate as date) - 60 as "end", o_orderstatus as form, o_totalprice as val, o_orderkey as id from orders)"""
_CUTS = "cuts as (select c_custkey as ticker, y as vintage, make_date(y, 1, 1) as cutoff from customer, (values (1996), (1998), (2000)) v(y))"


def _cuts(spark, sf_dir):
    years = F.explode(F.array(*[F.lit(y) for y in (1996, 1998, 2000)]))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ticker"), years.alias("vintage"))
    return c.withColumn("cutoff", F.make_date("vintage", F.lit(1), F.lit(1)))


@query(
    "merge_left_fold",
    """select o_orderkey, o_custkey, o_totalprice, c_mktsegment, c_nationkey, n_name from orders
       left join (select * from customer where c_custkey % 7 <> 0) on o_custkey = c_custkey left join (select * from nation where n_regionkey <> 2) on c_nationkey = n_nationkey""",
)
def merge_left_fold(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("key"), "o_totalprice")
    c = table(spark, sf_dir, "customer").where("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("key"), "c_mktsegment", "c_nationkey", F.lit(0.0).alias("o_totalprice"))
    merged = joins.left_merge(o, [c], ["key"])
    n = table(spark, sf_dir, "nation").where("n_regionkey <> 2").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return joins.left_merge(merged, [n], ["c_nationkey"]).withColumnRenamed("key", "o_custkey")


@query(
    "overlay_override",
    """select o_orderkey, case when l_extendedprice is not null then l_extendedprice else o_totalprice end as o_totalprice,
         case when l_linestatus is not null then l_linestatus else o_orderstatus end as o_orderstatus,
         round(greatest(date_diff('day', date '1996-01-01', cast(o_orderdate as date)) / 365.25, 0.01), 6) as years
       from orders left join (select * from lineitem where l_linenumber = 1 and l_quantity > 40) on l_orderkey = o_orderkey""",
)
def overlay_override(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderdate")
    patch = table(spark, sf_dir, "lineitem").where("l_linenumber = 1 and l_quantity > 40")
    patch = patch.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_extendedprice").alias("o_totalprice"), F.col("l_linestatus").alias("o_orderstatus"))
    years = F.greatest(F.datediff(F.col("o_orderdate"), F.lit("1996-01-01").cast("date")) / 365.25, F.lit(0.01))
    return joins.overlay(o, patch, ["o_orderkey"], ["o_totalprice", "o_orderstatus"]).select("o_orderkey", "o_totalprice", "o_orderstatus", F.round(years, 6).alias("years"))


@query(
    "backfill_coalesce",
    """select c_custkey, case when c_custkey % 5 = 0 or c_custkey % 7 = 0 then n_name else c_mktsegment end as segment from customer join nation on c_nationkey = n_nationkey""",
)
def backfill_coalesce(spark, sf_dir):
    blank = F.when(F.col("c_custkey") % 5 == 0, F.lit(None)).when(F.col("c_custkey") % 7 == 0, F.lit(" ")).otherwise(F.col("c_mktsegment"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", blank.alias("segment"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("segment"))
    return joins.backfill(c, n, "c_nationkey", ["segment"]).select("c_custkey", "segment")


@query(
    "lookup_broadcast",
    """select s_suppkey, case when s_nationkey % 5 = 1 then upper(r_name) else n_name end as place from supplier left join nation on s_nationkey = n_nationkey left join region on n_regionkey = r_regionkey""",
)
def lookup_broadcast(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    over = n.where("n_nationkey % 5 = 1").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    over = over.select(F.col("n_nationkey").alias("s_nationkey"), F.upper("r_name").alias("name"))
    names = n.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("name"))
    return joins.lookup(table(spark, sf_dir, "supplier"), names, "s_nationkey", "name", "place", over).select("s_suppkey", "place")


@query(
    "asof_strict",
    f"""with {_FILINGS}, {_CUTS} select c.ticker, c.vintage, c.cutoff, max(f.filed) as filed, max_by(f.val, (f.filed, f.id)) as val
        from cuts c left join filings f on f.ticker = c.ticker and f.filed < c.cutoff group by 1, 2, 3""",
)
def asof_strict(spark, sf_dir):
    return joins.asof_backward(_cuts(spark, sf_dir), _orders(spark, sf_dir), "ticker", "cutoff", "filed", "val", "id")


@query(
    "asof_latest_by_end",
    f"""with {_FILINGS}, {_CUTS}, r as (select c.ticker, c.vintage, c.cutoff, f."end", f.val, row_number() over (partition by c.ticker, c.vintage order by f."end" desc, f.filed, f.id) as n
        from cuts c left join filings f on f.ticker = c.ticker and f.filed < c.cutoff and f.form = 'F') select ticker, vintage, cutoff, "end", val from r where n = 1""",
)
def asof_latest_by_end(spark, sf_dir):
    f = joins.first_filed(_orders(spark, sf_dir).where("form = 'F'"), ["ticker"], "end", "id")
    return joins.asof_by(_cuts(spark, sf_dir), f, ["ticker"], "cutoff", "filed", "end", "val")


@query(
    "asof_n_back",
    f"""with {_FILINGS}, {_CUTS}, k as (select c.ticker, c.vintage, c.cutoff, f."end", f.val, f.id, max(year(f."end")) over (partition by c.ticker, c.vintage) as latest
          from cuts c join filings f on f.ticker = c.ticker and f.filed < c.cutoff),
        b as (select *, row_number() over (partition by ticker, vintage order by "end" desc, id) as n from k where year("end") = latest - 1)
        select c.ticker, c.vintage, c.cutoff, b.val from cuts c left join b on b.ticker = c.ticker and b.vintage = c.vintage and n = 1""",
)
def asof_n_back(spark, sf_dir):
    f = joins.first_filed(_orders(spark, sf_dir), ["ticker"], "end", "id")
    return joins.periods_back(_cuts(spark, sf_dir), f, ["ticker"], "cutoff", "filed", "end", "val", 1)


@query(
    "first_nonnull_fallback",
    f"""with {_FILINGS}, {_CUTS}, l as (select c.ticker, c.vintage, c.cutoff,
          max_by(f.val, (f.filed, f.id)) filter (where f.form = 'P') as p, max_by(f.val, (f.filed, f.id)) filter (where f.form = 'F') as q
          from cuts c left join filings f on f.ticker = c.ticker and f.filed < c.cutoff group by 1, 2, 3)
        select ticker, vintage, cutoff, coalesce(p, q, -1) as val from l""",
)
def first_nonnull_fallback(spark, sf_dir):
    out = _cuts(spark, sf_dir)
    for form in ("P", "F"):
        found = joins.asof_backward(out, _orders(spark, sf_dir).where(F.col("form") == form), "ticker", "cutoff", "filed", "val", "id")
        out = found.drop("filed").withColumnRenamed("val", form)
    return out.select("ticker", "vintage", "cutoff", joins.first_known([F.col("P"), F.col("F"), F.lit(-1.0)]).alias("val"))


@query(
    "asof_forward",
    """select o_orderkey, min(ts) as first_ts from (select o_orderkey, o_custkey % 150 as key, o_orderdate as d from orders) o
       join (select user_id % 150 as key, ts from events) e on e.key = o.key and e.ts >= o.d + interval 8000 day group by 1""",
)
def asof_forward(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 150).alias("key"), "o_orderkey", (F.col("o_orderdate") + F.expr("interval 8000 day")).alias("d"))
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 150).alias("key"), "ts")
    # Forward is backward on the reversed clock.
    t0 = lambda c: -F.unix_micros(F.col(c).cast("timestamp"))
    back = joins.asof_backward(o.withColumn("at", t0("d")), e.select("key", t0("ts").alias("rts"), "ts", F.lit(0).alias("tie")), "key", "at", "rts", "ts", "tie", strict=False)
    return back.where("ts is not null").select("o_orderkey", F.col("ts").alias("first_ts"))


@query(
    "semi_baskets",
    """select o_orderkey, o_totalprice from orders where o_custkey in (select o_custkey from orders group by 1 having sum(o_totalprice) > 2500000)""",
)
def semi_baskets(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    basket = o.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("s")).where("s > 2500000")
    return o.join(basket, "o_custkey", "left_semi").select("o_orderkey", "o_totalprice")


@query("anti_resume", "select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem where l_quantity > 25)")
def anti_resume(spark, sf_dir):
    done = table(spark, sf_dir, "lineitem").where("l_quantity > 25").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.resume(table(spark, sf_dir, "orders"), done, ["o_orderkey"]).select("o_orderkey")


@query(
    "membership_replay",
    """with today as (select c_custkey as ticker from customer where c_custkey % 2 = 0),
       changes as (select o_custkey as ticker, cast(o_orderdate as date) as "when", max(case when o_orderkey % 3 = 0 then 0 else 1 end) as added, min(case when o_orderkey % 3 = 0 then 0 else 1 end) as least from orders group by 1, 2),
       cuts as (select make_date(y, 1, 1) as cutoff from (values (1996), (1999), (2001)) v(y)),
       f as (select cutoff, ticker, min_by(least, "when") as added from changes, cuts where "when" > cutoff group by 1, 2)
       select cutoff, ticker from f where added = 0
       union select cutoff, t.ticker from today t, cuts where not exists (select 1 from f where f.cutoff = cuts.cutoff and f.ticker = t.ticker)""",
)
def membership_replay(spark, sf_dir):
    import datetime

    today = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("ticker"))
    op = F.when(F.col("o_orderkey") % 3 == 0, "remove").otherwise("add")
    changes = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("ticker"), F.col("o_orderdate").cast("date").alias("when"), op.alias("op"))
    return joins.members_at(today, changes, [datetime.date(y, 1, 1) for y in (1996, 1999, 2001)])


@query(
    "fundamentals_row",
    f"""with {_FILINGS}, {_CUTS}, l as (select c.ticker, c.vintage,
          max_by(f.val, (f.filed, f.id)) filter (where f.form = 'F') as income, max_by(f.val, (f.filed, f.id)) filter (where f.form = 'O') as equity
          from cuts c left join filings f on f.ticker = c.ticker and f.filed < c.cutoff group by 1, 2)
        select ticker, vintage, round(income / equity, 4) as roe, case when income / equity < 0 then 'negative' when income / equity >= 0.2 then 'high' when income / equity >= 0.1 then 'solid' when income / equity is not null then 'low' end as roe_bucket from l""",
)
def fundamentals_row(spark, sf_dir):
    from presage.functions import buckets, finance

    out = _cuts(spark, sf_dir)
    for form, name in (("F", "income"), ("O", "equity")):
        found = joins.asof_backward(out, _orders(spark, sf_dir).where(F.col("form") == form), "ticker", "cutoff", "filed", "val", "id")
        out = found.drop("filed").withColumnRenamed("val", name)
    roe = finance.ratio(F.col("income"), F.col("equity"), None)
    return out.select("ticker", "vintage", F.round(roe, 4).alias("roe"), buckets.bucket("roe", roe).alias("roe_bucket"))


@query(
    "dataset_meta",
    f"""with {FIRMS_SQL}, t as (select *, case when vintage < 2000 then cls end as outcome from firms)
        select count(*) as n, count(segment) as graded, count(outcome) as with_outcome, string_agg(distinct cast(vintage as varchar), ',' order by cast(vintage as varchar)) as vintages,
          string_agg(distinct case when outcome is not null then cast(vintage as varchar) end, ',' order by case when outcome is not null then cast(vintage as varchar) end) as outcome_vintages,
          (select string_agg(distinct cast(vintage as varchar), ',' order by cast(vintage as varchar)) from t where vintage not in (select vintage from t where outcome is not null)) as forecast_vintages from t""",
)
def dataset_meta(spark, sf_dir):
    t = firms(spark, sf_dir).withColumn("outcome", F.when(F.col("vintage") < 2000, F.col("cls")))
    return sinks.meta(t, "vintage", F.col("segment").isNotNull(), F.col("outcome"))


@query("forecast_cohort", f"with {FIRMS_SQL} select id, ticker, segment, region from firms where vintage = (select max(vintage) from firms) and segment is not null")
def forecast_cohort(spark, sf_dir):
    f = firms(spark, sf_dir)
    last = f.agg(F.max("vintage").alias("last"))
    return f.crossJoin(F.broadcast(last)).where((F.col("vintage") == F.col("last")) & F.col("segment").isNotNull()).select("id", "ticker", "segment", "region")


@query(
    "columnar_submissions",
    """select o_custkey as ticker, o_orderstatus as form, cast(o_orderdate as date) as filed, cast(o_orderkey as varchar) as accession from orders where o_orderstatus <> 'P'""",
)
def columnar_submissions(spark, sf_dir):
    """Filings written as parallel arrays, a document a company, and read back."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("ticker"), F.struct("o_orderkey", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd").alias("d")).alias("r"))
    r = o.groupBy("ticker").agg(F.sort_array(F.collect_list("r")).alias("r"))
    recent = F.struct(
        F.col("r.o_orderstatus").alias("form"), F.col("r.d").alias("filingDate"), F.col("r.d").alias("reportDate"),
        F.transform("r.o_orderkey", lambda k: k.cast("string")).alias("accessionNumber"), F.col("r.d").alias("primaryDocument"), F.col("r.d").alias("items"),
    )
    docs = r.select("ticker", F.to_json(F.struct(F.struct(recent.alias("recent")).alias("filings"))).alias("json"))
    back = readers.submissions(docs, "ticker")
    return back.where("form <> 'P'").select("ticker", "form", "filed", F.col("accessionNumber").alias("accession"))


@query(
    "company_facts",
    """select o_custkey as cik, o_orderstatus as concept, cast(o_orderdate as date) as "end", round(o_totalprice, 2) as val from orders where date_diff('day', date '1995-01-01', cast(o_orderdate as date)) between 350 and 380 or o_orderkey % 2 = 0""",
)
def company_facts(spark, sf_dir):
    """Points written as nested facts, a document a company, read back and kept where an instant or a full year."""
    from presage.functions.finance import full_year

    o = table(spark, sf_dir, "orders")
    point = F.struct(
        F.when(F.col("o_orderkey") % 2 != 0, F.lit("1995-01-01")).alias("start"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("end"), F.col("o_totalprice").alias("val"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("filed"), F.lit("10-K").alias("form"), F.lit("FY").alias("fp"),
    )
    units = o.groupBy("o_custkey", "o_orderstatus").agg(F.collect_list(point).alias("points"))
    concepts = units.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderstatus", F.struct(F.create_map(F.lit("USD"), F.col("points")).alias("units"))))).alias("us-gaap"))
    docs = concepts.select(F.col("o_custkey").alias("cik"), F.to_json(F.struct(F.struct("us-gaap").alias("facts"))).alias("json"))
    back = readers.company_facts(docs, "cik")
    return back.where(full_year(F.col("start"), F.col("end"))).select("cik", "concept", "end", F.round("val", 2).alias("val"))


@query("ticker_index", "select upper(trim(c_name)) as ticker, c_custkey as cik, c_mktsegment as title from customer")
def ticker_index(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    entry = F.struct(F.col("c_custkey").alias("cik_str"), F.col("c_name").alias("ticker"), F.col("c_mktsegment").alias("title"))
    docs = c.groupBy((F.col("c_custkey") % 10).alias("page")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("c_custkey").cast("string"), entry))).alias("m"))
    return readers.ticker_index(docs.select(F.to_json("m").alias("json")))


@query("union_rows", "select s_name as name, s_nationkey as nationkey from supplier union all select c_name, c_nationkey from customer")
def union_rows(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nationkey"))
    return s.unionByName(table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nationkey")))


@query("set_difference", "select p_brand from part where p_size < 10 except select p_brand from part where p_size > 48")
def set_difference(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.where("p_size < 10").select("p_brand").subtract(p.where("p_size > 48").select("p_brand"))


@query("set_intersection", "select p_brand from part where p_size < 3 intersect select p_brand from part where p_size > 48")
def set_intersection(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.where("p_size < 3").select("p_brand").intersect(p.where("p_size > 48").select("p_brand"))


@query("engine_rows", """select o_orderkey, case when o_orderkey % 11 = 0 then concat('{"id":', o_orderkey, '}') else concat('{"id":', o_orderkey, ',"status":"', o_orderstatus, '"}') end as json from orders""")
def engine_rows(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderstatus")).alias("status"))
    rows = sinks.json_rows(o.select("id", "status"))
    return rows.select(F.get_json_object("json", "$.id").cast("bigint").alias("o_orderkey"), "json")


@query("csv_round_trip", "select s_suppkey, s_name, case when s_suppkey % 3 = 0 then null else s_acctbal end as s_acctbal from supplier")
def csv_round_trip(spark, sf_dir):
    """Rows as CSV text with a comment line, parsed under a given schema; NaN is missing."""
    s = table(spark, sf_dir, "supplier")
    lines = s.select(F.concat_ws(",", F.col("s_suppkey").cast("string"), "s_name", F.when(F.col("s_suppkey") % 3 == 0, "NaN").otherwise(F.col("s_acctbal").cast("string"))).alias("value"))
    parsed = lines.select(F.from_csv("value", "s_suppkey bigint, s_name string, s_acctbal double").alias("c")).select("c.*")
    return parsed.withColumn("s_acctbal", F.when(~F.isnan("s_acctbal"), F.col("s_acctbal")))
