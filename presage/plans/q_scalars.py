"""Queries of scalar functions and buckets."""

from __future__ import annotations

from pyspark.sql import functions as F

from presage.functions import buckets, finance, text
from presage.operators import ranking
from presage.plans.core import FIRMS_SQL, firms, query, rounded, table

#: name -> (bands, expression of the number in both dialects, CASE in SQL over x).
_CASES = {
    "bucket_outcome": ("outcome", "o_totalprice / 1000000 - 0.15", "when x < -0.10 then 'disaster' when x < 0 then 'poor' when x < 0.07 then 'market' when x < 0.13 then 'good' else 'great'"),
    "bucket_momentum": ("momentum", "o_totalprice / 4000 - 40", "when x >= 30 then 'strong' when x <= -10 then 'weak' else 'neutral'"),
    "bucket_volatility": ("volatility", "o_totalprice / 5000", "when x >= 40 then 'high' when x <= 22 then 'low' else 'medium'"),
    "bucket_pe": ("pe", "o_totalprice / 5000 - 20", "when x < 0 then 'negative_earnings' when x < 15 then 'cheap' when x <= 30 then 'fair' else 'expensive'"),
    "bucket_growth": ("growth", "o_totalprice / 1000000 - 0.2", "when x >= 0.15 then 'high' when x <= 0 then 'shrinking' else 'moderate'"),
    "bucket_leverage": ("leverage", "o_totalprice / 150000 - 0.5", "when x < 0 then 'negative_equity' when x < 0.5 then 'low' when x <= 1.5 then 'moderate' else 'high'"),
    "bucket_roe": ("roe", "o_totalprice / 1000000 - 0.1", "when x < 0 then 'negative' when x >= 0.20 then 'high' when x >= 0.10 then 'solid' else 'low'"),
    "bucket_20d": ("return_20d", "o_totalprice / 10000 - 25", "when x <= -10 then 'sharp_down' when x <= -3 then 'down' when x < 3 then 'flat' when x < 10 then 'up' else 'sharp_up'"),
    "bucket_reaction_3": ("reaction_3", "o_totalprice / 20000 - 12", "when x <= -3 then 'down' when x < 3 then 'flat' else 'up'"),
    "bucket_1d": ("reaction_1d", "o_totalprice / 20000 - 12", "when x <= -2 then 'down' when x < 2 then 'flat' else 'up'"),
    "bucket_confidence": ("confidence", "o_totalprice / 600000", "when x >= 0.50 then 'HIGH' when x >= 0.30 then 'MEDIUM' else 'LOW'"),
}


def _bucket(name: str, band: str, x: str, case: str) -> None:
    x = f"case when o_orderkey % 11 = 0 then null else {x} end"

    @query(name, f"with t as (select o_orderkey, {x} as x from orders) select o_orderkey, case when x is null then null {case} end as bucket from t")
    def run(spark, sf_dir):
        t = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(x).alias("x"))
        return t.select("o_orderkey", buckets.bucket(band, F.col("x")).alias("bucket"))


for _name, (_band, _x, _case) in _CASES.items():
    _bucket(_name, _band, _x, _case)


@query(
    "grade_pips",
    """select o_orderkey, case o_orderstatus when 'F' then 5 when 'O' then 3 else 1 end as moat_pips,
         case when o_orderkey % 11 = 0 then null when o_orderpriority = '1-URGENT' then 5 when o_orderpriority = '2-HIGH' then 4 else 3 end as position_pips
       from orders""",
)
def grade_pips(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    moat = F.when(F.col("o_orderstatus") == "F", "wide").when(F.col("o_orderstatus") == "O", "narrow").otherwise("none")
    position = F.when(F.col("o_orderpriority") == "1-URGENT", "dominant").when(F.col("o_orderpriority") == "2-HIGH", "strong").otherwise("other")
    position = F.when(F.col("o_orderkey") % 11 != 0, position)
    return o.select("o_orderkey", buckets.pips("moat_strength", moat).alias("moat_pips"), buckets.pips("market_position", position).alias("position_pips"))


@query(
    "qcut_deciles",
    """with e as (select quantile_cont(c_acctbal, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) as edges from customer)
       select c_custkey, cast(greatest(1, len(list_filter(edges, lambda v: v < c_acctbal))) as int) as decile from customer, e""",
)
def qcut_deciles(spark, sf_dir):
    return ranking.deciles(table(spark, sf_dir, "customer"), "c_acctbal").select("c_custkey", "decile")


@query(
    "theme_level",
    """with e as (select quantile_cont(c_acctbal, [0.25, 0.5, 0.75]) as edges from customer)
       select c_custkey, concat('L', len(list_filter(edges, lambda v: v <= c_acctbal))) as level from customer, e""",
)
def theme_level(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    edges = ranking.quantiles(c, [], "c_acctbal", [0.25, 0.5, 0.75], "edges")
    return c.crossJoin(F.broadcast(edges)).select("c_custkey", buckets.level(F.col("c_acctbal"), F.col("edges")).alias("level"))  # one row


@query(
    "equal_width_bins",
    """select cast(greatest(0, ceil(o_totalprice / 600000 * 10) - 1) as int) as bin, count(*) as n from orders group by 1""",
)
def equal_width_bins(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.groupBy(buckets.equal_width_bin(F.col("o_totalprice") / 600000).alias("bin")).agg(F.count("*").alias("n"))


@query(
    "cagr",
    """with t as (select o_orderkey, case when o_orderkey % 11 = 0 then null else o_totalprice / 2000 - 100 end as r, cast(o_orderkey % 13 as double) as y, o_totalprice as p from orders)
       select o_orderkey,
         round(case when y > 0 and r >= -100 then power(1 + r / 100, 1 / y) - 1 end, 6) as total_cagr,
         round(case when r is not null then (power(1 + greatest(r, -100) / 100, 1 / greatest(coalesce(nullif(y, 12), 10), 0.5)) - 1) * 100 end, 6) as held_cagr,
         round(case when p - 100000 > 0 then power(p / (p - 100000), 1.0 / 3) - 1 end, 6) as growth_cagr,
         round(case when r is not null then ln(1 + greatest(r * 1.5, -99) / 100) end, 6) as log_return
       from t""",
)
def cagr(spark, sf_dir):
    t = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 11 != 0, F.col("o_totalprice") / 2000 - 100).alias("r"), (F.col("o_orderkey") % 13).cast("double").alias("y"), F.col("o_totalprice").alias("p")
    )
    r, y, p = F.col("r"), F.col("y"), F.col("p")
    out = t.select(
        "o_orderkey", finance.cagr_from_total_return(r, y).alias("total_cagr"),
        F.when(r.isNotNull(), finance.backtest_cagr(r, F.nullif(y, F.lit(12.0)))).alias("held_cagr"),
        finance.cagr(p - 100000, p, 3).alias("growth_cagr"), F.when(r.isNotNull(), finance.floored_log_return(r * 1.5)).alias("log_return"),
    )
    return rounded(out, "total_cagr", "held_cagr", "growth_cagr", "log_return")


@query(
    "range_labels",
    """with y as (select * from (values (1.0::double), (6.0), (12.0)) v(years)), c as (
         select years, [round((power(0.9, years) - 1) * 100), 0, round((power(1.07, years) - 1) * 100), round((power(1.13, years) - 1) * 100)] as p from y),
       t as (select years, list_transform(p, lambda v: concat(case when v < 0 then '-' else '+' end, cast(abs(v) as bigint), '%')) as s from c)
       select years, concat('< ', s[1]) as disaster, concat(s[1], ' to ', s[2]) as poor, concat(s[2], ' to ', s[3]) as market,
         concat(s[3], ' to ', s[4]) as good, concat('>= ', s[4]) as great from t""",
)
def range_labels(spark, sf_dir):
    y = spark.createDataFrame([(1.0,), (6.0,), (12.0,)], "years double")
    return y.select("years", *[c.alias(k) for k, c in finance.range_labels(F.col("years")).items()])


@query(
    "valuation_ratios",
    """with t as (select l_orderkey, l_linenumber, l_extendedprice as price, l_quantity as shares,
           case when l_linenumber = 3 then 0 else l_extendedprice * (l_discount - 0.03) end as income, l_extendedprice * (l_tax - 0.02) as equity from lineitem)
       select l_orderkey, l_linenumber, round(price * shares, 4) as market_cap, round(price * shares / nullif(income, 0), 4) as pe_ratio,
         round(income / nullif(price * shares, 0), 6) as earnings_yield, round(case when equity > 0 then price * shares / equity end, 4) as pb_ratio,
         round(income / nullif(equity, 0), 4) as return_on_equity from t""",
)
def valuation_ratios(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("shares"),
        F.when(F.col("l_linenumber") == 3, 0.0).otherwise(F.col("l_extendedprice") * (F.col("l_discount") - 0.03)).alias("income"),
        (F.col("l_extendedprice") * (F.col("l_tax") - 0.02)).alias("equity"),
    )
    v = finance.valuation(F.col("price"), F.col("shares"), F.col("income"), F.col("equity"))
    digits = {"market_cap": 4, "pe_ratio": 4, "earnings_yield": 6, "pb_ratio": 4}
    roe = finance.ratio(F.col("income"), F.nullif(F.col("equity"), F.lit(0.0)))
    return t.select("l_orderkey", "l_linenumber", *[F.round(c, digits[k]).alias(k) for k, c in v.items()], roe.alias("return_on_equity"))


@query(
    "fold_md5",
    f"with {FIRMS_SQL} select fold, count(distinct ticker) as tickers, count(*) as n from firms group by fold",
)
def fold_md5(spark, sf_dir):
    return firms(spark, sf_dir).groupBy("fold").agg(F.countDistinct("ticker").alias("tickers"), F.count("*").alias("n"))


@query(
    "smart_title",
    """with t as (select p_partkey, case when p_partkey % 2 = 0 then upper(concat(p_name, ' of the ', p_type)) else p_name end as name from part),
       w as (select p_partkey, name, upper(name) = name and lower(name) <> name as shout, string_split(lower(name), ' ') as words from t)
       select p_partkey, case when shout then array_to_string(list_transform(list_filter(words, lambda x: x <> ''),
         lambda x: case when x in ('and', 'of', 'the') then x else concat(upper(x[1]), substr(x, 2)) end), ' ') else name end as title from w""",
)
def smart_title(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    name = F.when(F.col("p_partkey") % 2 == 0, F.upper(F.concat("p_name", F.lit(" of the "), "p_type"))).otherwise(F.col("p_name"))
    return p.select("p_partkey", text.smart_title(name).alias("title"))


@query(
    "clean_label",
    """select c_custkey, trim(regexp_replace(concat(' ', c_name, '[1] ', c_mktsegment, '[note] '), '\\[[^\\]\\n]*\\]', '', 'g')) as name,
         concat('segment = ', c_mktsegment) as label, replace(lower(c_mktsegment), '_', ' ') as pretty, cast(least(100, trunc(c_acctbal / 10000 / 5 * 100)) as int) as bar from customer""",
)
def clean_label(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    noted = F.concat(F.lit(" "), F.col("c_name"), F.lit("[1] "), F.col("c_mktsegment"), F.lit("[note] "))
    bar = F.least(F.lit(100), (F.col("c_acctbal") / 10000 / 5 * 100).cast("int"))
    return c.select(
        "c_custkey", text.without_footnotes(noted).alias("name"), text.label("segment", F.col("c_mktsegment")).alias("label"),
        F.replace(F.lower("c_mktsegment"), F.lit("_"), F.lit(" ")).alias("pretty"), bar.alias("bar"),
    )


@query(
    "date_parse",
    """select o_orderkey, case o_orderkey % 5 when 4 then null else cast(o_orderdate as date) end as day,
         case o_orderkey % 5 when 4 then null else cast(year(o_orderdate) as int) end as y, strftime(o_orderdate, '%B %Y') as month_label,
         cast(date_diff('day', cast(o_orderdate as date), date '2002-01-01') as int) as age from orders""",
)
def date_parse(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    shape = F.col("o_orderkey") % 5
    written = (
        F.when(shape == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(shape == 1, F.date_format("o_orderdate", "MMMM d, yyyy"))
        .when(shape == 2, F.date_format("o_orderdate", "d MMMM yyyy")).when(shape == 3, F.date_format("o_orderdate", "MM/dd/yyyy")).otherwise("soon")
    )
    day = text.date_of(written)
    return o.select(
        "o_orderkey", day.alias("day"), F.year(day).alias("y"), F.date_format("o_orderdate", "MMMM yyyy").alias("month_label"),
        F.datediff(F.lit("2002-01-01").cast("date"), F.col("o_orderdate")).alias("age"),
    )


@query(
    "full_year_periods",
    """select l_orderkey, l_linenumber from lineitem join orders on l_orderkey = o_orderkey
       where l_linenumber = 1 or date_diff('day', cast(o_orderdate as date), cast(l_shipdate as date) + cast(300 as int)) between 350 and 380""",
)
def full_year_periods(spark, sf_dir):
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    start = F.when(F.col("l_linenumber") != 1, F.to_date("o_orderdate"))
    return j.where(finance.full_year(start, F.date_add(F.to_date("l_shipdate"), 300))).select("l_orderkey", "l_linenumber")


@query(
    "json_props",
    "select event_type, cast(json_extract(props, '$.k') as bigint) as k, count(*) as n from events group by 1, 2",
)
def json_props(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    k = F.from_json("props", "k bigint")["k"]
    return e.groupBy("event_type", k.alias("k")).agg(F.count("*").alias("n"))


_ITEMS = "['2.02', '9.01', '5.02', '1.01', '9.99', '5.03', '8.01', '2.05']"


@query(
    "items_theme",
    f"""with t as (select event_id, concat({_ITEMS}[event_id % 8 + 1], ', ', {_ITEMS}[event_id // 8 % 8 + 1], ',') as items from events),
        s as (select event_id, items, list_filter(list_transform(string_split(items, ','), lambda x: trim(x)), lambda x: x <> '' and x not in ('9.01', '5.03', '5.05', '8.03')) as telling from t),
        m as (select event_id, items, telling, list_filter(list_transform(telling, lambda x: case x when '2.02' then 'earnings' when '5.02' then 'management change'
          when '1.01' then 'material agreement' when '8.01' then 'other material news' when '2.05' then 'restructuring' end), lambda x: x is not null) as known from s)
        select event_id, case when len(known) > 0 then known[1] when len(telling) > 0 then 'other' else 'exhibits only' end as theme from m""",
)
def items_theme(spark, sf_dir):
    codes = F.array(*[F.lit(c) for c in ("2.02", "9.01", "5.02", "1.01", "9.99", "5.03", "8.01", "2.05")])
    at = lambda x: F.element_at(codes, (x % 8 + 1).cast("int"))
    i = F.col("event_id")
    joined = F.concat(at(i), F.lit(", "), at(F.floor(i / 8)), F.lit(","))
    return table(spark, sf_dir, "events").select("event_id", text.theme(joined).alias("theme"))


@query(
    "stratified_folds",
    f"with {FIRMS_SQL} select id, cast((row_number() over (partition by cls order by id) - 1) % 5 as int) as k from firms",
)
def stratified_folds(spark, sf_dir):
    from presage.operators.bayes import stratified_fold

    return stratified_fold(firms(spark, sf_dir).select("id", "cls"), "cls", "id", 5, "k").select("id", "k")


@query(
    "stratified_sample",
    f"""with {FIRMS_SQL}, s as (select id, cls, row_number() over (partition by cls order by id) - 1 as r, cast(greatest(2, round((select count(*) from firms) / 300.0)) as bigint) as k from firms)
        select id, cls from s where r % k = 0""",
)
def stratified_sample(spark, sf_dir):
    f = firms(spark, sf_dir)
    n = f.agg(F.greatest(F.lit(2), F.round(F.count("*") / 300.0)).cast("bigint").alias("k"))
    placed = ranking.grouped_rank(f.select("id", "cls"), ["cls"], [F.col("id")], "r")
    return placed.crossJoin(F.broadcast(n)).where((F.col("r") - 1) % F.col("k") == 0).select("id", "cls")  # one row
