"""Queries of aggregates, lifts, windows and event studies."""

from __future__ import annotations

from pyspark.sql import functions as F

from presage.operators import events, lift, ranking
from presage.plans.core import CLASSES, FEATURES, FIRMS_SQL, PRESENT_SQL, PRICES_SQL, firms, prices, query, rounded, table
from presage.streaming import windows

_HIT = "cls = '1-URGENT'"


@query(
    "lift_table",
    f"""with {FIRMS_SQL}, {PRESENT_SQL}, base as (select avg(case when {_HIT} then 1.0 else 0 end) as b from firms)
        select field, value, count(*) as n, round(avg(case when {_HIT} then 1.0::double else 0 end) / (select b from base), 6) as lift from u group by 1, 2 having count(*) >= 8""",
)
def lift_table(spark, sf_dir):
    return rounded(lift.lift_table(firms(spark, sf_dir), FEATURES, F.col("cls") == CLASSES[0], 8), "lift")


@query(
    "lift_top10",
    f"""with {FIRMS_SQL}, {PRESENT_SQL}, base as (select avg(case when {_HIT} then 1.0 else 0 end) as b from firms),
        t as (select field, value, count(*) as n, round(avg(case when {_HIT} then 1.0::double else 0 end) / (select b from base), 6) as lift from u group by 1, 2 having count(*) >= 8)
        select field, value, n, lift, cast(least(100, trunc(lift / 5 * 100)) as int) as bar from t order by lift desc, field, value limit 10""",
)
def lift_top10(spark, sf_dir):
    t = rounded(lift.lift_table(firms(spark, sf_dir), FEATURES, F.col("cls") == CLASSES[0], 8), "lift")
    bar = F.least(F.lit(100), (F.col("lift") / 5 * 100).cast("int")).alias("bar")
    return t.select("field", "value", "n", "lift", bar).orderBy(F.desc("lift"), "field", "value").limit(10)


@query(
    "lift_by_group",
    f"""with {FIRMS_SQL}, {PRESENT_SQL}, v as (select u.*, f.vintage from u join (select id, vintage from firms) f using (id)),
        base as (select vintage, avg(case when {_HIT} then 1.0::double else 0 end) as b from firms group by 1)
        select v.vintage, field, value, count(*) as n, round(avg(case when {_HIT} then 1.0::double else 0 end) / min(b), 6) as lift from v join base on base.vintage = v.vintage where b > 0 group by 1, 2, 3 having count(*) >= 8""",
)
def lift_by_group(spark, sf_dir):
    return rounded(lift.lift_table(firms(spark, sf_dir), FEATURES, F.col("cls") == CLASSES[0], 8, ["vintage"]), "lift")


@query(
    "drift_probe",
    f"""with {FIRMS_SQL}, {PRESENT_SQL}, v as (select u.*, f.vintage from u join (select id, vintage from firms) f using (id)),
        base as (select vintage, avg(case when {_HIT} then 1.0::double else 0 end) as b from firms group by 1),
        l as (select v.vintage, field, value, avg(case when {_HIT} then 1.0::double else 0 end) / min(b) as lift from v join base on base.vintage = v.vintage where b > 0 group by 1, 2, 3 having count(*) >= 8)
        select field, value, round(avg(lift), 6) as lift_mean, round(min(lift), 6) as lift_min, round(max(lift), 6) as lift_max, round((max(lift) - min(lift)) / avg(lift), 6) as drift from l group by 1, 2 having count(*) >= 2""",
)
def drift_probe(spark, sf_dir):
    lifts = lift.lift_table(firms(spark, sf_dir), FEATURES, F.col("cls") == CLASSES[0], 8, ["vintage"])
    return rounded(lift.drift(lifts, "vintage"), "lift_mean", "lift_min", "lift_max", "drift")


@query(
    "lift_two_way",
    f"""with {FIRMS_SQL}, {PRESENT_SQL}, b as (select avg((rank = 0)::int) as u, avg((rank >= 3)::int) as d from firms)
        select field, value, count(*) as n, round(avg((rank = 0)::int) / min(b.u), 6) as lift_up, round(avg((rank >= 3)::int) / min(b.d), 6) as lift_down from u, b group by 1, 2 having count(*) >= 12""",
)
def lift_two_way(spark, sf_dir):
    out = lift.two_way_lift(firms(spark, sf_dir), FEATURES, F.col("rank") == 0, F.col("rank") >= 3, 12)
    return rounded(out, "lift_up", "lift_down")


@query(
    "lift_scoped",
    f"""with {FIRMS_SQL}, {PRESENT_SQL}, s as (select 'all' as scope, id, cls from firms union all select concat('status ', status), id, cls from firms union all select concat('size ', size), id, cls from firms),
        b as (select scope, avg(case when {_HIT} then 1.0::double else 0 end) as b from s group by 1)
        select s.scope, field, value, count(*) as n, round(avg(case when s.{_HIT} then 1.0::double else 0 end) / min(b), 6) as lift from s join u using (id) join b on b.scope = s.scope group by 1, 2, 3""",
)
def lift_scoped(spark, sf_dir):
    scopes = {"all": F.lit(True)}
    scopes |= {f"status {s}": F.col("status") == s for s in "FOP"} | {f"size {s}": F.col("size") == s for s in ("small", "medium", "large")}
    return rounded(lift.scoped_lift(firms(spark, sf_dir), FEATURES, F.col("cls") == CLASSES[0], scopes), "lift")


@query(
    "mode_tiebreak",
    """with c as (select o_custkey, o_orderpriority, count(*) as n, min(o_orderkey) as f from orders group by 1, 2)
       select o_custkey, o_orderpriority, n from (select *, row_number() over (partition by o_custkey order by n desc, f) as r from c) where r = 1""",
)
def mode_tiebreak(spark, sf_dir):
    return lift.mode(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderpriority", "o_orderkey")


@query(
    "column_profile",
    f"""with {FIRMS_SQL}, l as (select 'segment' as field, segment as value from firms where segment is not null union select 'nation', nation from firms union select 'status', status from firms union select 'size', size from firms)
        select field, count(*) as cardinality, case when count(*) <= 12 then string_agg(value, '|' order by value) end as values from l group by 1""",
)
def column_profile(spark, sf_dir):
    return lift.column_profile(firms(spark, sf_dir), ["segment", "nation", "status", "size"])


@query(
    "weighted_mean",
    f"with {FIRMS_SQL}, g as (select region, fold, count(*) as n, avg(price) as x from firms group by 1, 2) select region, round(sum(n * x) / sum(n), 4) as mean from g group by 1",
)
def weighted_mean(spark, sf_dir):
    g = firms(spark, sf_dir).groupBy("region", "fold").agg(F.count("*").alias("n"), F.avg("price").alias("x"))
    return g.groupBy("region").agg(F.round(F.sum(F.col("n") * F.col("x")) / F.sum("n"), 4).alias("mean"))


@query(
    "upper_median",
    "with r as (select c_mktsegment, c_acctbal, row_number() over (partition by c_mktsegment order by c_acctbal) - 1 as i, count(*) over (partition by c_mktsegment) as n from customer) select c_mktsegment, c_acctbal as upper_median from r where i = n // 2",
)
def upper_median(spark, sf_dir):
    r = ranking.grouped_rank(table(spark, sf_dir, "customer").select("c_mktsegment", "c_acctbal"), ["c_mktsegment"], [F.col("c_acctbal")], "place", "n")
    return r.where(F.col("place") - 1 == F.floor(F.col("n") / 2)).select("c_mktsegment", F.col("c_acctbal").alias("upper_median"))


@query(
    "target_mean_encoding",
    f"with {FIRMS_SQL}, {PRESENT_SQL} select field, value, round(avg(rank), 6) as mean_rank, count(*) as n from u group by 1, 2",
)
def target_mean_encoding(spark, sf_dir):
    u = lift.unpivot(firms(spark, sf_dir), ["rank"], FEATURES)
    return u.groupBy("field", "value").agg(F.round(F.avg("rank"), 6).alias("mean_rank"), F.count("*").alias("n"))


@query(
    "confusion_matrix",
    f"""with {FIRMS_SQL}, p as (select cls as true, ['{"', '".join(CLASSES)}'][cast(floor(price / 100000) as int) % 4 + 1] as pred from firms), c as (select unnest(['{"', '".join(CLASSES)}']) as x)
        select a.x as true, b.x as pred, count(p.true) as n from c a cross join c b left join p on p.true = a.x and p.pred = b.x group by 1, 2""",
)
def confusion_matrix(spark, sf_dir):
    pred = F.element_at(F.array(*[F.lit(c) for c in CLASSES]), (F.floor(F.col("price") / 100000) % 4 + 1).cast("int"))
    return ranking.confusion(firms(spark, sf_dir).withColumn("pred", pred), "cls", "pred", CLASSES)


@query(
    "ordinal_error",
    f"""with {FIRMS_SQL}, d as (select cast(floor(price / 100000) as int) % 4 - rank as d from firms)
        select count(*) as n, round(avg((d = 0)::int), 6) as exact, round(avg((abs(d) <= 1)::int), 6) as within_one, round(avg((abs(d) >= 3)::int), 6) as far,
          round(avg((d > 0)::int), 6) as optimistic, round(avg((d < 0)::int), 6) as pessimistic from d""",
)
def ordinal_error(spark, sf_dir):
    out = ranking.ordinal_error(firms(spark, sf_dir), F.col("rank"), (F.floor(F.col("price") / 100000) % 4).cast("int"))
    return rounded(out, "exact", "within_one", "far", "optimistic", "pessimistic")


@query(
    "top_abs_per_group",
    "select c_mktsegment, c_custkey, c_acctbal, cast(r as int) as rank from (select *, row_number() over (partition by c_mktsegment order by abs(c_acctbal - 4500) desc, c_custkey) as r from customer) where r <= 8",
)
def top_abs_per_group(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("x", F.col("c_acctbal") - 4500)
    return lift.top_absolute(c, ["c_mktsegment"], "x", "c_custkey").select("c_mktsegment", "c_custkey", "c_acctbal", "rank")


@query(
    "custom_order",
    """select c_mktsegment, count(*) as n, coalesce(list_position(['MACHINERY', 'BUILDING'], c_mktsegment), 99) as place from customer group by 1""",
)
def custom_order(spark, sf_dir):
    names = F.array(F.lit("MACHINERY"), F.lit("BUILDING"))
    place = F.coalesce(F.nullif(F.array_position(names, F.col("c_mktsegment")), F.lit(0)), F.lit(99)).cast("int")
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n")).withColumn("place", place).orderBy("place", "c_mktsegment")


#: Events as news on twenty price series that are long enough for a year of rows.
_REACT = f"""{PRICES_SQL}, q as (select key % 20 as key, ts, close, theme, event_id from prices),
  p as (select *, lag(close) over w as anchor, lead(close, 1) over w as c1, lead(close, 5) over w as c5, lead(close, 20) over w as c20, lead(close, 252) over w as c252 from q window w as (partition by key order by ts, event_id)),
  e as (select key, event_id, theme, ts + interval 1 minute as at from q),
  x as (select e.key, e.event_id, e.theme, p.anchor, p.c1, p.c5, p.c20, p.c252 from e asof join p on p.key = e.key and p.ts >= e.at),
  r as (select key, event_id, theme, (c1 / anchor - 1) * 100 as r_1, (c5 / anchor - 1) * 100 as r_5, (c20 / anchor - 1) * 100 as r_20, (c252 / anchor - 1) * 100 as r_252 from x where anchor > 0)"""


def _reactions(spark, sf_dir):
    p = prices(spark, sf_dir).withColumn("key", F.col("key") % 20)
    e = p.select("key", "event_id", "theme", (F.col("ts") + F.expr("interval 1 minute")).alias("at"))
    return events.reactions(p.select("key", "ts", "close", "event_id"), e, "key", "ts", "close", "at", tie="event_id")


@query("reaction_offsets", f"with {_REACT} select key, event_id, round(r_1, 4) as r_1, round(r_5, 4) as r_5, round(r_20, 4) as r_20, round(r_252, 4) as r_252 from r")
def reaction_offsets(spark, sf_dir):
    r = ["r_1", "r_5", "r_20", "r_252"]
    return rounded(_reactions(spark, sf_dir).select("key", "event_id", *r), *r, digits=4)


@query(
    "momentum_vol",
    f"""with {PRICES_SQL}, q as (select *, case when close > 0 and lag(close) over w > 0 then ln(close / lag(close) over w) end as r, count(*) over (w rows 251 preceding) as n, first_value(close) over (w rows 251 preceding) as f from prices window w as (partition by key order by ts)),
        s as (select key, ts, case when n >= 30 and f > 0 then (close / f - 1) * 100 end as momentum, count(r) over (w rows 250 preceding) as nr, stddev_samp(r) over (w rows 250 preceding) as sd from q window w as (partition by key order by ts))
        select key, ts, round(momentum, 4) as momentum, round(case when nr > 20 then sd * sqrt(252.0::double) * 100 end, 4) as volatility from s""",
)
def momentum_vol(spark, sf_dir):
    return rounded(events.momentum_volatility(prices(spark, sf_dir), "key", "ts", "close"), "momentum", "volatility", digits=4)


@query(
    "forward_20d",
    f"""with {PRICES_SQL}, w as (select key, ts, lead(close, 21) over x as b, lead(close, 1) over x as a, lag(close, 1) over x as d, lag(close, 60) over x as c from prices window x as (partition by key order by ts))
        select key, ts, round(case when a > 0 then (b / a - 1) * 100 end, 4) as forward, round(case when c > 0 then (d / c - 1) * 100 end, 4) as momentum from w""",
)
def forward_20d(spark, sf_dir):
    return rounded(events.forward_return(prices(spark, sf_dir), "key", "ts", "close", 20, 60), "forward", "momentum", digits=4)


@query(
    "theme_stats",
    f"""with {_REACT}, t as (select theme, count(*) as n, avg(r_1) as mean_1d, median(r_1) as median_1d, avg((r_1 > 0)::int) as share_up, corr(r_1, r_20) as corr, count(*) filter (where r_1 > 0) as n_up, count(*) filter (where r_1 < 0) as n_down,
          median(r_1) filter (where r_1 > 0) - median(r_1) filter (where r_1 < 0) as gap_1d, median(r_252) filter (where r_1 > 0) - median(r_252) filter (where r_1 < 0) as gap_1yr from r where r_1 is not null group by 1 having count(*) >= 30)
        select theme, n, round(mean_1d, 4) as mean_1d, round(median_1d, 4) as median_1d, round(share_up, 6) as share_up, round(corr, 6) as corr, n_up, n_down, round(gap_1d, 4) as gap_1d, round(gap_1yr, 4) as gap_1yr,
          case when gap_1d > 0 and n_up >= 40 and n_down >= 40 then case when gap_1yr >= 4 then 'fundamentals' when gap_1yr <= 1.5 then 'sentiment' when gap_1yr is not null then 'mixed' end end as verdict from t""",
)
def theme_stats(spark, sf_dir):
    out = events.theme_stats(_reactions(spark, sf_dir), "theme", "r_1", "r_20", "r_252")
    return rounded(rounded(out, "share_up", "corr"), "mean_1d", "median_1d", "gap_1d", "gap_1yr", digits=4)


@query(
    "cohort_paths",
    f"""with {_REACT} select theme, case when r_1 > 0 then 'up' else 'down' end as cohort, count(*) as n, round(median(r_1), 4) as median_r_1, round(median(r_5), 4) as median_r_5, round(median(r_20), 4) as median_r_20, round(median(r_252), 4) as median_r_252 from r where r_1 <> 0 group by 1, 2""",
)
def cohort_paths(spark, sf_dir):
    out = events.cohort_paths(_reactions(spark, sf_dir), "theme", "r_1", ["r_1", "r_5", "r_20", "r_252"])
    return rounded(out, "median_r_1", "median_r_5", "median_r_20", "median_r_252", digits=4)


@query(
    "corr_gated",
    f"with {_REACT} select theme, round(corr(r_1, r_5), 6) as corr from r where r_1 is not null and r_5 is not null group by 1 having count(*) >= 100",
)
def corr_gated(spark, sf_dir):
    r = _reactions(spark, sf_dir).where("r_1 is not null and r_5 is not null")
    return r.groupBy("theme").agg(F.corr("r_1", "r_5").alias("corr"), F.count("*").alias("n")).where("n >= 100").select("theme", F.round("corr", 6).alias("corr"))


@query(
    "signal_separation",
    f"""with {_REACT}, f as (select event_id, case event_id % 3 when 0 then 'a' when 1 then 'b' else 'c' end as tone, case when event_id % 7 < 2 then 'low' else 'high' end as beat, theme, r_1, r_5, r_20 from r),
        u as (select 'tone' as field, tone as value, r_1, r_5, r_20 from f union all select 'beat', beat, r_1, r_5, r_20 from f union all select 'theme', theme, r_1, r_5, r_20 from f),
        m as (select field, value, avg(r_1) as m1, avg(r_5) as m5, avg(r_20) as m20 from u group by 1, 2 having count(*) >= 15)
        select field, count(*) as values, round(max(m1) - min(m1), 4) as sep_r_1, round(max(m5) - min(m5), 4) as sep_r_5, round(max(m20) - min(m20), 4) as sep_r_20 from m group by 1 having count(*) >= 2""",
)
def signal_separation(spark, sf_dir):
    """How far the means of a signal's values lie apart, at three horizons."""
    tone = F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("event_id") % 3 + 1).cast("int"))
    r = _reactions(spark, sf_dir).withColumns({"tone": tone, "beat": F.when(F.col("event_id") % 7 < 2, "low").otherwise("high")})
    out = lift.separation(r, ["tone", "beat", "theme"], ["r_1", "r_5", "r_20"], 15)
    return rounded(out, "sep_r_1", "sep_r_5", "sep_r_20", digits=4)


@query(
    "drift_mean",
    f"""with {FIRMS_SQL}, {PRESENT_SQL}, v as (select u.*, f.vintage from u join (select id, vintage from firms) f using (id)),
        base as (select vintage, avg(case when {_HIT} then 1.0::double else 0 end) as b from firms group by 1),
        l as (select v.vintage, field, value, avg(case when {_HIT} then 1.0::double else 0 end) / min(b) as lift from v join base on base.vintage = v.vintage where b > 0 group by 1, 2, 3 having count(*) >= 8),
        d as (select field, value, (max(lift) - min(lift)) / avg(lift) as drift from l group by 1, 2 having count(*) >= 2) select count(*) as n, round(avg(drift), 6) as mean_drift from d""",
)
def drift_mean(spark, sf_dir):
    lifts = lift.lift_table(firms(spark, sf_dir), FEATURES, F.col("cls") == CLASSES[0], 8, ["vintage"])
    return rounded(lift.mean_drift(lift.drift(lifts, "vintage")), "mean_drift")


@query(
    "lift_strength",
    f"""with {FIRMS_SQL}, {PRESENT_SQL}, base as (select avg(case when {_HIT} then 1.0 else 0 end) as b from firms),
        t as (select field, value, avg(case when {_HIT} then 1.0::double else 0 end) / (select b from base) as lift from u group by 1, 2)
        select field, value, round(case when lift > 0 then abs(ln(lift)) else 0 end, 6) as strength from t order by round(case when lift > 0 then abs(ln(lift)) else 0 end, 9) desc, field, value limit 10""",
)
def lift_strength(spark, sf_dir):
    """The ten values that tell most, for or against."""
    t = lift.by_strength(lift.lift_table(firms(spark, sf_dir), FEATURES, F.col("cls") == CLASSES[0]), "field", "value").limit(10)
    return rounded(t.select("field", "value", "strength"), "strength")


@query(
    "terminal_outcome",
    f"""with {PRICES_SQL}, b as (select min(ts) as lo, max(ts) as hi from prices), h as (select distinct key, lo + interval 3 day as s, hi - interval 1 day as e from prices, b),
        g as (select h.key, h.s, h.e, min(p.ts) filter (where p.ts < h.s + interval 14 day) as f, max(p.ts) as l from h left join prices p on p.key = h.key and p.ts between h.s and h.e group by 1, 2, 3)
        select g.key, round(case when a.close > 0 then (z.close / a.close - 1) * 100 end, 4) as total_return, round(date_diff('day', cast(f as date), cast(l as date)) / 365.25, 6) as years, l >= e - interval 14 day as survived
        from g left join prices a on a.key = g.key and a.ts = f left join prices z on z.key = g.key and z.ts = l""",
)
def terminal_outcome(spark, sf_dir):
    p = prices(spark, sf_dir)
    b = p.agg((F.min("ts") + F.expr("interval 3 day")).alias("s"), (F.max("ts") - F.expr("interval 1 day")).alias("e"))
    h = p.select("key").distinct().crossJoin(F.broadcast(b))  # one row
    out = events.terminal_return(p, h, "key", "ts", "close", "s", "e").select("key", "total_return", "years", "survived")
    return rounded(rounded(out, "years"), "total_return", digits=4)


@query(
    "terminal_window",
    f"""with {PRICES_SQL}, b as (select min(ts) as lo, max(ts) as hi from prices), h as (select distinct key, lo + interval 9 day as s, hi - interval 1 day as e from prices, b),
        g as (select h.key, h.s, h.e, min(p.ts) filter (where p.ts < h.s + interval 14 day) as f, max(p.ts) as l from h left join prices p on p.key = h.key and p.ts between h.s - interval 7 day and h.e group by 1, 2, 3)
        select g.key, round(case when a.close > 0 then (z.close / a.close - 1) * 100 end, 4) as total_return, l >= e - interval 14 day as survived
        from g left join prices a on a.key = g.key and a.ts = f left join prices z on z.key = g.key and z.ts = l""",
)
def terminal_window(spark, sf_dir):
    """The first close of a window that opens seven days before the start."""
    p = prices(spark, sf_dir)
    b = p.agg((F.min("ts") + F.expr("interval 9 day")).alias("s"), (F.max("ts") - F.expr("interval 1 day")).alias("e"))
    h = p.select("key").distinct().crossJoin(F.broadcast(b))  # one row
    return rounded(events.terminal_return(p, h, "key", "ts", "close", "s", "e", before=7).select("key", "total_return", "survived"), "total_return", digits=4)


@query("stream_tumbling", "select event_type, time_bucket(interval 1 day, ts) as start, count(*) as n from events group by 1, 2")
def stream_tumbling(spark, sf_dir):
    return windows.tumbling(table(spark, sf_dir, "events"), "ts", ["event_type"], "1 day")


@query(
    "stream_sessions",
    """with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 6 hour then 0 else 1 end as new from events),
       s as (select user_id, ts, sum(new) over (partition by user_id order by ts) as k from g) select user_id, min(ts) as start, count(*) as n from s group by user_id, k""",
)
def stream_sessions(spark, sf_dir):
    return windows.sessions(table(spark, sf_dir, "events"), "ts", ["user_id"], "6 hours")


@query("stream_sliding", """with s as (select event_type, ts, time_bucket(interval 1 day, ts) as b from events), w as (select event_type, b as start from s union all select event_type, b - interval 1 day from s)
    select event_type, start, count(*) as n from w group by 1, 2""")
def stream_sliding(spark, sf_dir):
    return windows.sliding(table(spark, sf_dir, "events"), "ts", ["event_type"], "2 days", "1 day")


@query("stream_first_seen", "select distinct user_id, event_type from events")
def stream_first_seen(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "ts")
    return windows.first_seen(e, "ts", ["user_id", "event_type"]).select("user_id", "event_type")
