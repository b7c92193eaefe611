"""Ranks and quantiles without a task that sees a whole group; calibration, confusion, ranked funds and similar rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from presage.functions.buckets import equal_count_bin, equal_width_bin, quantile_bin
from presage.operators.staging import materialize


def _same(left: str, right: str, keys: list[str]) -> Column:
    """Equality of both sides' keys, nulls being equal."""
    return reduce(Column.__and__, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys])


def grouped_rank(df: DataFrame, by: list[str], order: list[Column], out: str, total: str | None = None) -> DataFrame:
    """df with out: each row's place from 1 in its group's order; and with total, the group's size.

    Rows are dealt by range of (by, order, a hash of the row), so that neither a
    group nor a tie of any size stays in one task: only rows that are equal in
    every column do, and a caller who has many of those adds an id. Sorted ranges
    are stored with their running number; a row's place is that number, less the
    first of its group's part, more the sizes of the parts before, a row for each
    task and group.
    """
    keys, salt = [F.col(c) for c in by], F.xxhash64(*[c for c, kind in df.dtypes if not kind.startswith("map")])
    dealt = df.repartitionByRange(*keys, *order, salt).sortWithinPartitions(*keys, *order, salt)
    dealt = materialize(dealt.withColumn("_at", F.monotonically_increasing_id()), "ranges")
    dealt = dealt.withColumn("_part", F.shiftrightunsigned("_at", 33))
    names = ["_part", *by]
    sizes = dealt.groupBy(*names).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    group = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_n").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*names, (before + 1 - F.col("_first")).alias("_shift"), F.sum("_n").over(group).alias("_all"))
    joined = dealt.alias("l").join(sizes.alias("r"), _same("l", "r", names))
    extra = [F.col("r._all").alias(total)] if total else []
    return joined.select(*[F.col(f"l.{c}") for c in df.columns], (F.col("l._at") + F.col("r._shift")).alias(out), *extra)


#: Distinct (group, value) pairs up to which one aggregate reads a quantile off their counts.
HISTOGRAM = 1_000_000


def quantiles(df: DataFrame, by: list[str], x: str, probs: list[float], out: str = "q", limit: int = HISTOGRAM, weight: str | None = None) -> DataFrame:
    """(by..., out): the exact linear quantiles of x as an array, for each group that has any x; without `by` always one row.

    Equal values of a group become one row and a count before anything is
    shuffled, so a constant column is a row a task. Up to `limit` such rows,
    which are counted, one aggregate reads the quantiles off the counts. Beyond,
    the distinct values are dealt by range; the counts' sums by range tell which
    ranges hold the wanted places, and only those are numbered. weight: a column
    that says how many rows a row stands for.
    """
    size = F.sum(weight) if weight else F.count("*")
    held = df.where(F.col(x).isNotNull()).groupBy(*by, F.col(x).cast("double").alias(x)).agg(size.alias("_n"))
    ask = F.array(*[F.lit(float(p)) for p in probs])
    counts = materialize(held, "histogram")
    if counts.count() <= limit:
        value = F.percentile(F.col(x), ask, F.col("_n")).alias(out)
        return counts.groupBy(*by).agg(value) if by else counts.agg(value)
    keys = [F.col(c) for c in by]
    dealt = materialize(counts.repartitionByRange(*keys, x).withColumn("_part", F.spark_partition_id()), "ranges")
    parts = dealt.groupBy("_part", *by).agg(F.sum("_n").alias("_m"))
    group = Window.partitionBy(*keys)
    upto = F.sum("_m").over(group.orderBy("_part"))
    parts = parts.select("_part", *by, (upto - F.col("_m")).alias("_before"), upto.alias("_upto"), F.sum("_m").over(group).alias("_all"))
    places = F.flatten(F.transform(ask, lambda p: F.array(F.floor(p * (F.col("_all") - 1)), F.ceil(p * (F.col("_all") - 1)))))
    wanted = F.array_distinct(F.filter(places, lambda at: (at >= F.col("_before")) & (at < F.col("_upto"))))
    parts = parts.withColumn("_at", wanted).where(F.size("_at") > 0)
    rows = dealt.alias("l").join(parts.alias("r"), _same("l", "r", ["_part", *by])).select("l.*", "_before", "_all", "_at")
    ends = F.sum("_n").over(Window.partitionBy("_part", *keys).orderBy(x)) + F.col("_before")
    rows = rows.withColumn("_end", ends).withColumn("_at", F.filter("_at", lambda at: (at >= F.col("_end") - F.col("_n")) & (at < F.col("_end"))))
    few = rows.where(F.size("_at") > 0).groupBy(*by) if by else rows.where(F.size("_at") > 0)
    found = few.agg(F.max("_all").alias("_all"), F.map_from_entries(F.flatten(F.collect_list(F.transform("_at", lambda at: F.struct(at, F.col(x)))))).alias("_v"))

    def read(p: Column) -> Column:
        at = p * (F.col("_all") - 1)
        low, high = F.col("_v")[F.floor(at)], F.col("_v")[F.ceil(at)]
        return low + (high - low) * (at - F.floor(at))

    return found.select(*by, F.transform(ask, read).alias(out))


def calibration(df: DataFrame, p: str, hit: str, key: str, bins: int = 10) -> DataFrame:
    """(bin, n, predicted, actual) over bins of equal count in order of (p, key)."""
    placed = grouped_rank(df.select(p, hit, key), [], [F.col(p), F.col(key)], "_rn", "_total")
    binned = placed.withColumn("bin", equal_count_bin(F.col("_rn"), F.col("_total"), bins))
    return binned.groupBy("bin").agg(F.count("*").alias("n"), F.avg(p).alias("predicted"), F.avg(F.col(hit).cast("double")).alias("actual"))


def brier(df: DataFrame, p: str, hit: str) -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.avg(F.pow(F.col(p) - F.col(hit).cast("double"), F.lit(2))).alias("brier"))


def reliability(df: DataFrame, conf: str, hit: str, bins: int = 10, least: float = 0.0) -> DataFrame:
    """(bin, n, mean_conf, accuracy, gap) over bins of equal width."""
    out = df.where(F.col(conf) >= least).groupBy(equal_width_bin(F.col(conf), bins).alias("bin"))
    out = out.agg(F.count("*").alias("n"), F.avg(conf).alias("mean_conf"), F.avg(F.col(hit).cast("double")).alias("accuracy"))
    return out.withColumn("gap", F.col("mean_conf") - F.col("accuracy"))


def confusion(df: DataFrame, true: str, pred: str, classes: list[str]) -> DataFrame:
    """(true, pred, n) for every pair of classes, 0 where none."""
    counts = df.groupBy(F.col(true).alias("true"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))
    names = F.array(*[F.lit(c) for c in classes])
    grid = df.sparkSession.range(1).select(F.explode(names).alias("true")).select("true", F.explode(names).alias("pred"))
    return grid.join(counts, ["true", "pred"], "left").select("true", "pred", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def ordinal_error(df: DataFrame, true_rank: Column, pred_rank: Column) -> DataFrame:
    """One row: shares of exact, within one, three or more off, optimistic and pessimistic predictions."""
    d = pred_rank - true_rank
    share = lambda c: F.avg(c.cast("double"))
    return df.agg(
        F.count("*").alias("n"), share(d == 0).alias("exact"), share(F.abs(d) <= 1).alias("within_one"), share(F.abs(d) >= 3).alias("far"),
        share(d > 0).alias("optimistic"), share(d < 0).alias("pessimistic"),
    )


def deciles(df: DataFrame, x: str, bins: int = 10, out: str = "decile") -> DataFrame:
    """df with x's bin between linear quantiles, from 1."""
    edges = quantiles(df, [], x, [i / bins for i in range(bins)], "_edges")
    return df.crossJoin(F.broadcast(edges)).withColumn(out, quantile_bin(F.col(x), F.col("_edges"))).drop("_edges")  # one row


def fund_stats(df: DataFrame, score: str, key: str, ret: str, sizes: tuple[int, ...] = (20, 50, 100), bottom: int = 20) -> DataFrame:
    """(fund, n, mean, median, excess, hit_rate) of the best `sizes` by score and the worst `bottom`; ties by key.

    The top and the bottom are two bounded top-k plans; no row number over all
    rows. The scores are computed once, into a table.
    """
    most = max(sizes)
    df = materialize(df.select(key, score, ret), "scores")
    top = df.orderBy(F.desc(score), key).limit(most)  # a top-k report
    top = top.withColumn("_r", F.row_number().over(Window.orderBy(F.desc(score), key)))
    funds = F.filter(F.array(*[F.struct(F.lit(s).alias("s"), F.lit(f"top{s}").alias("fund")) for s in sizes]), lambda f: f["s"] >= F.col("_r"))
    top = top.select(ret, F.explode(funds).alias("f")).select(F.col("f.fund").alias("fund"), ret)
    low = df.orderBy(score, F.desc(key)).limit(bottom).select(F.lit(f"bottom{bottom}").alias("fund"), ret)
    base = df.agg(F.avg(ret).alias("_base"))
    out = top.unionByName(low).groupBy("fund").agg(F.count("*").alias("n"), F.avg(ret).alias("mean"), F.median(ret).alias("median"), F.avg((F.col(ret) > 0).cast("double")).alias("hit_rate"))
    return out.crossJoin(F.broadcast(base)).select("fund", "n", "mean", "median", (F.col("mean") - F.col("_base")).alias("excess"), "hit_rate")  # one row


def fund_report(df: DataFrame, score: str, key: str, ret: str, growth: str, cls: str, good: list[str], sizes: tuple[int, ...] = (20, 50, 100), bottom: int = 20) -> DataFrame:
    """(fund, n, mean_total, median_total, growth, excess_growth, upside_hit, holdings) of the best `sizes` by score and the worst `bottom`; ties by key.

    excess_growth is against all rows' mean growth, upside_hit the share of holdings
    of a good class, holdings the keys from the best down. The top and the bottom are
    bounded top-k plans, and so are the arrays.
    """
    most = max(sizes)
    df = materialize(df.select(key, score, ret, growth, cls), "scores")
    top = df.orderBy(F.desc(score), key).limit(most)  # a top-k report
    top = top.withColumn("_r", F.row_number().over(Window.orderBy(F.desc(score), key)))
    funds = F.filter(F.array(*[F.struct(F.lit(s).alias("s"), F.lit(f"top{s}").alias("fund")) for s in sizes]), lambda f: f["s"] >= F.col("_r"))
    top = top.withColumn("_f", F.explode(funds)).withColumn("fund", F.col("_f.fund")).drop("_f")
    low = df.orderBy(score, F.desc(key)).limit(bottom).withColumn("_r", -F.row_number().over(Window.orderBy(score, F.desc(key))))
    held = top.unionByName(low.withColumn("fund", F.lit(f"bottom{bottom}")))
    out = held.groupBy("fund").agg(
        F.count("*").alias("n"), F.avg(ret).alias("mean_total"), F.median(ret).alias("median_total"), F.avg(growth).alias("growth"),
        F.avg(F.col(cls).isin(good).cast("double")).alias("upside_hit"), F.transform(F.array_sort(F.collect_list(F.struct("_r", key))), lambda h: h[key]).alias("holdings"),
    )
    base = df.agg(F.avg(growth).alias("_base"))
    out = out.crossJoin(F.broadcast(base))  # one row
    return out.select("fund", "n", "mean_total", "median_total", "growth", (F.col("growth") - F.col("_base")).alias("excess_growth"), "upside_hit", "holdings")


def top_by_group(df: DataFrame, group: str, score: str, key: str, ret: str, k: int = 20) -> DataFrame:
    """(group, n, fund_mean, market_mean, excess): each group's k best against the group's mean."""
    df = materialize(df.select(group, key, score, ret), "scores")
    best = df.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), key))).where(F.col("_r") <= k)
    fund = best.groupBy(group).agg(F.count("*").alias("n"), F.avg(ret).alias("fund_mean"))
    market = df.groupBy(group).agg(F.avg(ret).alias("market_mean"))
    return fund.join(market, group).withColumn("excess", F.col("fund_mean") - F.col("market_mean"))


def fold_means(df: DataFrame, fold: str, cls: str, x: str, classes: list[str], folds: list[int]) -> DataFrame:
    """(fold, means): for each held-out fold, x's mean over the other folds' rows of each class, as an array."""
    own = df.where(F.col(cls).isin(classes)).groupBy(fold, cls).agg(F.sum(x).alias("s"), F.count(x).alias("n"))
    names = F.array(*[F.lit(c) for c in classes])
    each = own.withColumn("model", F.explode(F.array(*[F.lit(f) for f in folds]))).where(F.col(fold) != F.col("model"))
    mean = each.groupBy("model", cls).agg(F.try_divide(F.sum("s"), F.sum("n")).alias("m"))
    found = mean.groupBy("model").agg(F.map_from_entries(F.collect_list(F.struct(F.col(cls), F.col("m")))).alias("m"))  # an entry a class
    return found.select(F.col("model").alias(fold), F.transform(names, lambda c: F.coalesce(F.try_element_at("m", c), F.lit(0.0))).alias("means"))


def fund_table(df: DataFrame, scores: str, names: list[str], key: str, ret: str, group: str, sizes: tuple[int, ...] = (20, 50, 100)) -> DataFrame:
    """(names..., size, mean, share_beating) of the best `sizes` rows under each of many scores, and the share of them above their group's mean.

    scores: an array of structs (names..., score), one for each portfolio, all made
    in the one scan. Each task keeps its best rows of each portfolio alone, so what
    is shuffled are so many rows a task. Ties go by key.
    """
    df = materialize(df, "scores")
    market = df.groupBy(group).agg(F.avg(ret).alias("_market"))
    flat = df.select(key, ret, group, F.explode(scores).alias("_s")).select(key, ret, group, "_s.*")
    order = Window.partitionBy(*names).orderBy(F.desc("score"), key)
    best = flat.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= max(sizes))
    met = best.join(market, group).withColumn("size", F.explode(F.filter(F.array(*[F.lit(s) for s in sizes]), lambda s: s >= F.col("_r"))))
    return met.groupBy(*names, "size").agg(F.avg(ret).alias("mean"), F.avg((F.col(ret) > F.col("_market")).cast("double")).alias("share_beating"))


def fund_means(df: DataFrame, scores: list[str], key: str, ret: str, sizes: tuple[int, ...] = (20, 50, 100)) -> DataFrame:
    """(name, top{size}...): the mean return of the best `sizes` rows under each column of scores; ties by key.

    All scores are computed once, into one table; each portfolio is a bounded top-k plan over it.
    """
    df, out = materialize(df.select(key, ret, *scores), "scores"), None
    for s in scores:
        order = [F.desc(s), F.col(key)]
        top = df.select(key, ret, s).orderBy(*order).limit(max(sizes))  # a top-k report
        top = top.withColumn("_r", F.row_number().over(Window.orderBy(*order)))
        row = top.groupBy(F.lit(s).alias("name")).agg(*[F.avg(F.when(F.col("_r") <= n, F.col(ret))).alias(f"top{n}") for n in sizes])
        out = row if out is None else out.unionByName(row)
    return out


def beats(funds: DataFrame) -> DataFrame:
    """One row: groups, and the share of them whose fund has a positive excess."""
    return funds.agg(F.count("*").alias("groups"), F.avg((F.col("excess") > 0).cast("double")).alias("share_beating"))


#: Tuples of each posting list that are scored first, to learn what a row must reach.
HEAD = 32
_SLACK = 1e-9


def similar(df: DataFrame, focal: DataFrame, key: str, fields: list[str], k: int = 6, outcome: str | None = None, head: int = HEAD) -> DataFrame:
    """(focal, key, score, rank): for each focal row the k rows that share most, a shared value counting ln(N / its rows).

    The focal row itself, and rows without an outcome if one is named, are left
    out before the k are taken. Rows of the same values score alike, so what is
    compared are the distinct tuples of values, each of which brings its k + 1
    first keys. Rows that share nothing have no score and are not reported.

    A threshold search: a focal tuple first scores the first `head` tuples of
    each of its values' lists; the (k + 1)-th best of those is what any other must
    reach. With its values in order of weight, a tuple whose first shared value is
    the i-th can reach the sum of the weights from i on at most, so only lists up to
    where that falls below are read: those of rare values, which are short. A pair is
    taken from the list of its first shared value alone, and scored there.
    """
    n = len(fields)
    values = F.array(*[F.coalesce(F.concat(F.lit("="), F.col(f).cast("string")), F.lit("")) for f in fields])
    rows = materialize(df.select(key, (F.col(outcome).isNotNull() if outcome else F.lit(True)).alias("_known"), values.alias("_v")), "rows")
    tuples = rows.groupBy("_v").agg(F.count("*").alias("_c"), F.max("_known").alias("_any")).withColumn("_t", F.monotonically_increasing_id())
    tuples = materialize(tuples, "tuples")
    total = tuples.agg(F.sum("_c").alias("_n"))
    long = tuples.select("_t", "_c", "_any", "_v", F.posexplode("_v").alias("_f", "_x")).where("_x <> ''")
    weight = long.groupBy("_f", "_x").agg(F.sum("_c").alias("_c")).crossJoin(F.broadcast(total))  # one row
    weight = weight.select("_f", "_x", F.ln(F.col("_n") / F.col("_c")).alias("_w"))
    asked = focal.select(F.col(key).alias("focal"), values.alias("_v")).join(tuples.select("_v", F.col("_t").alias("_q")), "_v").select("focal", "_q")
    asked = materialize(asked, "asked")
    # A focal tuple: its values in order of weight, greatest first, with the sum of the weights from each on.
    own = long.join(asked.select(F.col("_q").alias("_t")).distinct(), "_t", "left_semi").join(weight, ["_f", "_x"])
    own = own.groupBy(F.col("_t").alias("_q")).agg(F.sort_array(F.collect_list(F.struct((-F.col("_w")).alias("m"), "_f", "_x"))).alias("_o"))
    rest = F.transform("_o", lambda o, i: -F.aggregate(F.slice("_o", i + 1, n), F.lit(0.0), lambda x, y: x + y["m"]))
    own = materialize(own.withColumn("_rest", rest), "focal")
    met = lambda o: F.col("_v")[o["_f"]] == o["_x"]
    score = -F.aggregate(F.filter("_o", met), F.lit(0.0), lambda x, y: x + y["m"])
    lists = long.where("_any").select("_f", "_x", "_t", "_v")
    wanted = own.select("_q", "_o", "_rest", F.posexplode("_o").alias("_i", "_a")).select("*", F.col("_a._f").alias("_f"), F.col("_a._x").alias("_x")).drop("_a")
    # The first tuples of a list: of each of many parts of it first.
    heads = lists.join(wanted.select("_f", "_x").distinct(), ["_f", "_x"], "left_semi").withColumn("_b", F.pmod(F.xxhash64("_t"), F.lit(64)))
    for part in (["_f", "_x", "_b"], ["_f", "_x"]):
        heads = heads.withColumn("_r", F.row_number().over(Window.partitionBy(*part).orderBy("_t"))).where(F.col("_r") <= head).drop("_r")
    tried = wanted.join(heads.drop("_b"), ["_f", "_x"]).groupBy("_q", "_t").agg(F.max(score).alias("s"))
    bar = tried.groupBy("_q").agg(F.sort_array(F.collect_list("s"), asc=False).alias("s"))  # at most head scores for each field
    bar = bar.select("_q", F.coalesce(F.try_element_at("s", F.lit(k + 1)), F.lit(0.0)).alias("_bar"))
    open_ = wanted.join(bar, "_q").where(F.col("_rest")[F.col("_i")] >= F.col("_bar") - _SLACK)
    pairs = open_.join(lists, ["_f", "_x"]).where(~F.exists(F.slice("_o", F.lit(1), F.col("_i")), met)).withColumn("score", score)
    pairs = pairs.where(F.col("score") >= F.col("_bar") - _SLACK).select("_q", "_t", "score")
    known = rows.where("_known").join(tuples.select("_v", "_t"), "_v").select(key, "_t", F.pmod(F.xxhash64(key), F.lit(64)).alias("_b"))
    for part in (["_t", "_b"], ["_t"]):
        known = known.withColumn("_r", F.row_number().over(Window.partitionBy(*part).orderBy(key))).where(F.col("_r") <= k + 1).drop("_r")
    best = Window.partitionBy("_q").orderBy(F.desc(F.round("score", 9)), key)
    found = pairs.join(known.select("_t", key), "_t").withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k + 1)
    found = asked.join(found.select("_q", key, "score"), "_q").where(F.col("focal") != F.col(key))
    w = Window.partitionBy("focal").orderBy(F.desc(F.round("score", 9)), key)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("focal", key, "score", "rank")
