"""What relates to an outcome: lift tables over categorical fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from presage.functions.text import category


def unpivot(df: DataFrame, keep: list[str], fields: list[str], missing: bool = False) -> DataFrame:
    """A row (keep..., field, value) for each field; nulls are left out, or a category of their own if missing."""
    pairs = [F.struct(F.lit(f).alias("field"), (category(F.col(f)) if missing else F.col(f).cast("string")).alias("value")) for f in fields]
    long = df.select(*keep, F.explode(F.array(*pairs)).alias("_p")).select(*keep, "_p.field", "_p.value")
    return long if missing else long.where(F.col("value").isNotNull())


def _with_base(known: DataFrame, by: list[str], fields: list[str], marks: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(counts, base): n and the sums of marks for each (by..., field, value), and for each group of by whole, from one scan.

    Each row gives a pair without a field besides its fields' own. Both results
    choose from one aggregate by a value that it computes, not by a key, which
    would be pushed below it: so they share its exchange.
    """
    pairs = [F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]
    whole = F.struct(F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("value"))
    long = known.select(*by, *marks, F.explode(F.array(whole, *pairs)).alias("_p")).select(*by, *marks, "_p.field", "_p.value")
    long = long.where(F.col("field").isNull() | F.col("value").isNotNull())
    sums = [F.sum(c).alias(n) for c, n in marks.items()]
    found = long.groupBy(*by, "field", "value").agg(F.count("*").alias("n"), *sums, F.count("field").alias("_own"))
    base = found.where("_own = 0").select(*by, *[(F.col(n) / F.col("n")).alias(f"base_{n}") for n in marks.values()])
    return found.where("_own > 0").drop("_own"), base


def lift_table(df: DataFrame, fields: list[str], target: Column, least: int = 1, by: list[str] | None = None) -> DataFrame:
    """(by..., field, value, n, lift): P(target | field = value) / P(target), within each group of by.

    Rows without a target value take no part. Groups of base rate 0 have no lifts.
    """
    by = by or []
    known = df.withColumn("_t", target.cast("int")).where(F.col("_t").isNotNull())
    counts, base = _with_base(known, by, fields, {"_t": "hits"})
    joined = counts.join(base, by) if by else counts.crossJoin(F.broadcast(base))  # one row
    rate = F.col("base_hits")
    return joined.where((rate > 0) & (F.col("n") >= least)).select(*by, "field", "value", "n", (F.col("hits") / F.col("n") / rate).alias("lift"))


def two_way_lift(df: DataFrame, fields: list[str], up: Column, down: Column, least: int = 12) -> DataFrame:
    """(field, value, n, lift_up, lift_down) in one pass."""
    known = df.withColumns({"_u": up.cast("int"), "_d": down.cast("int")}).where(F.col("_u").isNotNull() & F.col("_d").isNotNull())
    counts, base = _with_base(known, [], fields, {"_u": "u", "_d": "d"})
    out = counts.where(F.col("n") >= least).crossJoin(F.broadcast(base))  # one row
    lift = lambda hits: F.try_divide(F.col(hits) / F.col("n"), F.col(f"base_{hits}"))
    return out.select("field", "value", "n", lift("u").alias("lift_up"), lift("d").alias("lift_down"))


def scoped_lift(df: DataFrame, fields: list[str], target: Column, scopes: dict[str, Column], least: int = 1) -> DataFrame:
    """(scope, field, value, n, lift): lift tables within overlapping populations, counted in one pass."""
    tags = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in scopes.items()]))
    return lift_table(df.withColumn("_target", target).withColumn("scope", F.explode(tags)), fields, F.col("_target"), least, ["scope"])


def drift(lifts: DataFrame, by: str, groups: int = 2) -> DataFrame:
    """(field, value, lift_mean, lift_min, lift_max, drift) over groups: (max - min) / mean."""
    out = lifts.groupBy("field", "value").agg(
        F.count(by).alias("_n"), F.avg("lift").alias("lift_mean"), F.min("lift").alias("lift_min"), F.max("lift").alias("lift_max")
    )
    spread = F.try_divide(F.col("lift_max") - F.col("lift_min"), F.col("lift_mean"))
    return out.where(F.col("_n") >= groups).drop("_n").withColumn("drift", spread)


def mean_drift(drifts: DataFrame) -> DataFrame:
    """One row: how many lifts there are in two groups or more, and the mean of their drifts."""
    return drifts.agg(F.count("*").alias("n"), F.avg("drift").alias("mean_drift"))


def by_strength(lifts: DataFrame, *keys: str) -> DataFrame:
    """Lifts in order of |ln lift|, greatest first; one of 0 or less counts as no news."""
    strength = F.when(F.col("lift") > 0, F.abs(F.ln("lift"))).otherwise(0.0)
    return lifts.withColumn("strength", strength).orderBy(F.desc(F.round("strength", 9)), *keys)


def mode(df: DataFrame, keys: list[str], value: str, position: str) -> DataFrame:
    """The most frequent value of each key; of equals, the one seen first."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(position).alias("first"))
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), "first")
    return counts.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*keys, value, "n")


def top_absolute(df: DataFrame, by: list[str], value: str, key: str, k: int = 8) -> DataFrame:
    """Each group's k rows of greatest absolute value, ties by key."""
    w = Window.partitionBy(*by).orderBy(F.desc(F.abs(F.col(value))), key)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def column_profile(df: DataFrame, fields: list[str], most: int = 12) -> DataFrame:
    """(field, cardinality, values): the sorted distinct values where there are at most `most`.

    A field's values are dealt over many parts; each brings its count and its
    first `most` + 1 values.
    """
    distinct = unpivot(df, [], fields).distinct().withColumn("_b", F.pmod(F.xxhash64("value"), F.lit(64)))
    first = distinct.withColumn("_r", F.row_number().over(Window.partitionBy("field", "_b").orderBy("value")))
    parts = first.groupBy("field", "_b").agg(F.count("*").alias("n"), F.collect_list(F.when(F.col("_r") <= most + 1, F.col("value"))).alias("v"))
    out = parts.groupBy("field").agg(F.sum("n").alias("cardinality"), F.array_sort(F.flatten(F.collect_list("v"))).alias("v"))
    return out.select("field", "cardinality", F.when(F.col("cardinality") <= most, F.array_join("v", "|")).alias("values"))


def separation(df: DataFrame, fields: list[str], outcomes: list[str], least: int = 15) -> DataFrame:
    """(field, values, sep_<outcome>...): the greatest less the least mean of each outcome over a field's values of `least` rows or more."""
    u = unpivot(df, outcomes, fields).groupBy("field", "value").agg(F.count("*").alias("_n"), *[F.avg(o).alias(o) for o in outcomes])
    out = u.where(F.col("_n") >= least).groupBy("field").agg(F.count("*").alias("values"), *[(F.max(o) - F.min(o)).alias(f"sep_{o}") for o in outcomes])
    return out.where(F.col("values") >= 2)
