"""Event studies: reactions by row offset, momentum, volatility, themes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from presage.functions.buckets import verdict
from presage.operators.ranking import quantiles
from presage.operators.staging import materialize
from presage.operators.timeline import is_hot, running, shifted

HORIZONS = (1, 5, 20, 252)


def percent(later: Column, earlier: Column) -> Column:
    return F.when(earlier > 0, (later / earlier - 1) * 100)


def reactions(
    prices: DataFrame, events: DataFrame, key: str, ts: str, close: str, event_ts: str, horizons: tuple[int, ...] = HORIZONS, tie: str | None = None, limit: int | None = None
) -> DataFrame:
    """events with r_k: the close k rows after the first one at or after the event, against the last close before it.

    An event without an earlier close, or with one of 0 or less, gives no row.
    Each price row carries the closes ahead of it; an event finds its row by one
    pass over the key's merged timeline. A key of over `limit` rows is spread.
    Prices of one time are in order of tie.
    """
    order, hot = [F.col(ts), *([F.col(tie)] if tie else [])], is_hot(prices, [key], limit)
    prices = prices.withColumn("_tie", F.col(tie) if tie else F.lit(0))
    near = shifted(prices, [key], order, {"_anchor": (F.col(close), -1)} | {f"_c{h}": (F.col(close), h) for h in horizons}, hot)
    ahead = near.select(key, F.col(ts).alias("_ts"), "_tie", F.struct(F.col("_anchor").alias("anchor"), *[F.col(f"_c{h}").alias(f"c{h}") for h in horizons]).alias("_p"))
    extra = [c for c in events.columns if c != key]
    # First price row at or after the event: the first one behind it on the timeline, prices after events of the same time.
    both = ahead.select(key, "_ts", "_tie", F.lit(1).alias("_side"), "_p", F.lit(None).cast(events.select(F.struct(*extra)).schema[0].dataType).alias("_e")).unionByName(
        events.select(key, F.col(event_ts).alias("_ts"), F.lit(None).cast(ahead.schema["_tie"].dataType).alias("_tie"), F.lit(0).alias("_side"), F.lit(None).cast(ahead.schema["_p"].dataType).alias("_p"), F.struct(*extra).alias("_e"))
    )
    # Backwards, so that the frame only grows: a frame that shrinks from the front is computed anew for every row.
    back = [F.desc("_ts"), F.desc("_side"), F.desc("_tie")]
    found = running(both, [key], back, {"_f": ("last", F.col("_p"))}, hot or is_hot(events, [key], limit)).where("_side = 0 and _f.anchor > 0")
    return found.select(key, "_e.*", *[percent(F.col(f"_f.c{h}"), F.col("_f.anchor")).alias(f"r_{h}") for h in horizons])


def momentum_volatility(prices: DataFrame, key: str, ts: str, close: str, window: int = 252, least: int = 30, limit: int | None = None) -> DataFrame:
    """Per row: percent change over the window's closes, and yearly volatility of its daily log returns, where there are enough.

    Sums over a window are differences of running sums, so the work is linear in
    the rows, whatever the window. The returns are centred on their key's mean
    first, which keeps the sums of squares small.
    """
    hot, order, c = is_hot(prices, [key], limit), [F.col(ts)], F.col(close)
    rows = shifted(prices.select(key, ts, close), [key], order, {"_past": (c, -1)}, hot)
    rows = rows.withColumn("_r", F.when((c > 0) & (F.col("_past") > 0), F.ln(c / F.col("_past"))))
    if hot:
        means = rows.groupBy(key).agg(F.avg("_r").alias("_mean"))
        rows = rows.alias("l").join(means.alias("r"), F.col(f"l.{key}").eqNullSafe(F.col(f"r.{key}"))).select("l.*", "_mean")
    else:
        rows = rows.withColumn("_mean", F.avg("_r").over(Window.partitionBy(key)))
    x = F.col("_r") - F.col("_mean")
    sums = {"_n": ("sum", F.lit(1)), "_k": ("sum", F.col("_r").isNotNull().cast("long")), "_s": ("sum", F.coalesce(x, F.lit(0.0))), "_q": ("sum", F.coalesce(x * x, F.lit(0.0)))}
    rows = running(rows, [key], order, sums, hot)
    then = shifted(rows, [key], order, {"_close": (F.struct(c.alias("v")), -(window - 1)), "_then": (F.struct("_k", "_s", "_q"), -(window - 1))}, hot)
    opening = F.when(F.col("_n") == 1, F.struct(c.alias("v")))
    then = running(then, [key], order, {"_open": ("last", opening)}, hot)
    k, s, q = (F.col(n) - F.coalesce(F.col(f"_then.{n}"), F.lit(0)) for n in ("_k", "_s", "_q"))
    spread = F.sqrt(F.greatest((q - s * s / k) / (k - 1), F.lit(0.0)))
    return then.select(
        key, ts,
        F.when(F.col("_n") >= least, percent(c, F.coalesce("_close", "_open")["v"])).alias("momentum"),
        F.when(k > 20, spread * F.sqrt(F.lit(252.0)) * 100).alias("volatility"),
    )


def forward_return(prices: DataFrame, key: str, ts: str, close: str, days: int = 20, back: int = 60, limit: int | None = None) -> DataFrame:
    """Per row as the first at or after an event: the return from the next close over `days`, and the momentum of `back` earlier closes; null without enough rows."""
    c = F.col(close)
    near = shifted(prices.select(key, ts, close), [key], [F.col(ts)], {"_a": (c, days + 1), "_b": (c, 1), "_c": (c, -1), "_d": (c, -back)}, is_hot(prices, [key], limit))
    return near.select(key, ts, percent(F.col("_a"), F.col("_b")).alias("forward"), percent(F.col("_c"), F.col("_d")).alias("momentum"))


def theme_stats(events: DataFrame, theme: str, r1: str, r20: str, r252: str, least: int = 30) -> DataFrame:
    """Per theme of at least `least` events: n, mean, median, share up, correlation of day one with day 20, cohort medians, gap and verdict."""
    known = materialize(events.where(F.col(r1).isNotNull()).select(theme, r1, r20, r252), "reactions")
    up, down = F.col(r1) > 0, F.col(r1) < 0
    out = known.groupBy(theme).agg(
        F.count("*").alias("n"), F.avg(r1).alias("mean_1d"), F.avg(up.cast("double")).alias("share_up"),
        F.corr(r1, r20).alias("corr"), F.count(F.when(up, 1)).alias("n_up"), F.count(F.when(down, 1)).alias("n_down"),
    ).where(F.col("n") >= least)
    parts = {"all": (F.lit(True), r1), "up": (up, r1), "down": (down, r1), "up_1yr": (up, r252), "down_1yr": (down, r252)}
    mid = _medians(known, [theme], {name: F.when(c, F.col(x)) for name, (c, x) in parts.items()})
    out = out.alias("l").join(mid.alias("r"), F.col(f"l.{theme}").eqNullSafe(F.col(f"r.{theme}")), "left").select("l.*", *[f"r.{name}" for name in parts])
    out = out.withColumns({"gap_1d": F.col("up") - F.col("down"), "gap_1yr": F.col("up_1yr") - F.col("down_1yr")})
    out = out.withColumn("verdict", verdict(F.col("gap_1yr"), F.col("gap_1d"), F.col("n_up"), F.col("n_down")))
    return out.select(theme, "n", "mean_1d", F.col("all").alias("median_1d"), "share_up", "corr", "n_up", "n_down", "gap_1d", "gap_1yr", "verdict")


def _medians(df: DataFrame, by: list[str], measures: dict[str, Column]) -> DataFrame:
    """(by..., a column a measure): medians of what each measure has in each group, all measures in one ranking."""
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("_name"), x.cast("double").alias("_x")) for name, x in measures.items()]))
    found = quantiles(df.select(*by, each.alias("_e")).select(*by, "_e.*"), [*by, "_name"], "_x", [0.5])
    return found.groupBy(*by).agg(*[F.max(F.when(F.col("_name") == name, F.col("q")[0])).alias(name) for name in measures])


def cohort_paths(events: DataFrame, theme: str, first: str, horizons: list[str]) -> DataFrame:
    """(theme, cohort, n, median of each horizon) of the up and the down cohort by the sign of the first reaction."""
    cohort = F.when(F.col(first) > 0, "up").when(F.col(first) < 0, "down")
    rows = materialize(events.select(theme, cohort.alias("cohort"), *horizons).where(F.col("cohort").isNotNull()), "cohorts")
    sizes = rows.groupBy(theme, "cohort").agg(F.count("*").alias("n"))
    mid = _medians(rows, [theme, "cohort"], {f"median_{h}": F.col(h) for h in horizons})
    same = F.col(f"l.{theme}").eqNullSafe(F.col(f"r.{theme}")) & (F.col("l.cohort") == F.col("r.cohort"))
    return sizes.alias("l").join(mid.alias("r"), same, "left").select("l.*", *[f"r.median_{h}" for h in horizons])


def terminal_return(prices: DataFrame, holdings: DataFrame, key: str, ts: str, close: str, start: str, end: str, before: int = 0) -> DataFrame:
    """holdings with the first close from `before` days before to 14 days after start, the last close up to end, the total return and the years between.

    A last close over 14 days before the end means that the row did not survive.
    """
    ids = holdings.columns
    p = prices.select(key, F.col(ts).alias("_ts"), F.col(close).alias("_close"))
    near = holdings.join(p, key, "left").where(F.col("_ts").isNull() | ((F.col("_ts") >= F.col(start) - F.expr(f"interval {before} days")) & (F.col("_ts") <= F.col(end))))
    agg = near.groupBy(*ids).agg(
        F.min(F.when(F.col("_ts") < F.col(start) + F.expr("interval 14 days"), F.struct("_ts", "_close"))).alias("first"), F.max(F.struct("_ts", "_close")).alias("last")
    )
    years = F.datediff("last._ts", "first._ts") / 365.25
    return agg.select(
        *ids, percent(F.col("last._close"), F.col("first._close")).alias("total_return"), years.alias("years"),
        (F.col("last._ts") >= F.col(end) - F.expr("interval 14 days")).alias("survived"),
    )
