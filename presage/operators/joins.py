"""Merging, overlays, point-in-time lookups and membership replay."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from presage.functions.buckets import bucket
from presage.functions.finance import cagr_from_total_return
from presage.operators.timeline import is_hot, running


def left_merge(base: DataFrame, others: list[DataFrame], keys: list[str]) -> DataFrame:
    """base left-joined with each of others on keys; a column that is there already is not taken again."""

    def add(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.join(right.drop(*[c for c in right.columns if c in left.columns and c not in keys]), keys, "left")

    return reduce(add, others, base)


def lookup(df: DataFrame, table: DataFrame, key: str, column: str, out: str, overrides: DataFrame | None = None) -> DataFrame:
    """df with out: the key's column in overrides, else in table. Spark broadcasts what it finds small."""
    t = table.select(key, F.col(column).alias("_own"))
    df = df.join(t, key, "left")
    if overrides is None:
        return df.withColumnRenamed("_own", out)
    o = overrides.select(key, F.col(column).alias("_over"))
    return df.join(o, key, "left").withColumn(out, F.coalesce("_over", "_own")).drop("_own", "_over")


def overlay(df: DataFrame, patch: DataFrame, keys: list[str], columns: list[str], clears: str | None = None) -> DataFrame:
    """df with the columns of matching patch rows put over its own, where the patch has a value.

    clears: a boolean column of the patch; where it holds, the patch's nulls count as values too.
    """
    p = patch.select(*keys, (F.col(clears) if clears else F.lit(False)).alias("_clears"), *[F.col(c).alias(f"_p_{c}") for c in columns])
    out = df.join(p, keys, "left")
    put = {c: F.when(F.col("_clears"), F.col(f"_p_{c}")).otherwise(F.coalesce(f"_p_{c}", c)) for c in columns}
    return out.withColumns(put).drop("_clears", *[f"_p_{c}" for c in columns])


def overlay_outcomes(df: DataFrame, patch: DataFrame, keys: list[str], total_return: str, start: str, end: str) -> DataFrame:
    """df with a patch's start, end and total return (percent) put over, and window, yearly growth and outcome made anew.

    The window is the years between, at least a hundredth.
    """
    out = overlay(df, patch, keys, [total_return, start, end])
    out = out.withColumn("window", F.greatest(F.datediff(end, start) / 365.25, F.lit(0.01)))
    out = out.withColumn("cagr", cagr_from_total_return(F.col(total_return), F.col("window")))
    return out.withColumn("outcome", bucket("outcome", F.col("cagr")))


def backfill(df: DataFrame, constants: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """df with null or blank columns filled from the key's constants."""
    c = constants.select(key, *[F.col(x).alias(f"_c_{x}") for x in columns])
    fill = {x: F.when(F.trim(F.coalesce(F.col(x), F.lit(""))) == "", F.col(f"_c_{x}")).otherwise(F.col(x)) for x in columns}
    return df.join(c, key, "left").withColumns(fill).drop(*[f"_c_{x}" for x in columns])


def resume(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of todo whose key is not done."""
    return todo.join(done.select(*keys).distinct(), keys, "left_anti")


def asof_backward(left: DataFrame, right: DataFrame, key: str, cutoff: str, ts: str, value: str, tie: str, strict: bool = True, limit: int | None = None) -> DataFrame:
    """left with `value` and `ts` of the key's latest right row before the cutoff (null if none).

    Both sides are one timeline per key, over which the last right row is carried
    on: linear in the rows of a key, which is spread over tasks if it has more than
    `limit`. Of rows with equal ts the one with the greatest tie counts.
    """
    extra = [c for c in left.columns if c not in (key, cutoff)]
    last = F.struct(F.col(ts).alias("ts"), F.col(tie).alias("tie"), F.col(value).alias("value"))
    kinds = {f.name: f.dataType for f in left.schema.fields}
    r = right.where(F.col(ts).isNotNull()).select(
        F.col(key), F.col(ts).alias("_at"), F.lit(1 if strict else 0).alias("_side"), F.col(tie).alias("_tie"), last.alias("_right"),
        *[F.lit(None).cast(kinds[c]).alias(c) for c in extra],
    )
    none = F.lit(None)
    lft = left.select(
        F.col(key), F.col(cutoff).alias("_at"), F.lit(0 if strict else 1).alias("_side"), none.cast(right.schema[tie].dataType).alias("_tie"),
        none.cast(r.schema["_right"].dataType).alias("_right"), *extra,
    )
    both = r.withColumn("_left", F.lit(False)).unionByName(lft.withColumn("_left", F.lit(True)))
    order = [F.col("_at"), F.col("_side"), F.col("_tie").asc_nulls_first()]
    seen = running(both, [key], order, {"_last": ("last", F.col("_right"))}, is_hot(both, [key], limit)).where("_left")
    return seen.select(key, F.col("_at").alias(cutoff), *extra, F.col("_last.ts").alias(ts), F.col("_last.value").alias(value))


def asof_by(left: DataFrame, right: DataFrame, keys: list[str], cutoff: str, filed: str, order: str, value: str, limit: int | None = None) -> DataFrame:
    """left with `order` and `value` of the key's right row filed before the cutoff of greatest order; of equals, the earliest filed.

    A running maximum over the keys' merged timeline, linear in its rows and spread
    over tasks beyond `limit` of them. Every left row comes back once, repeated ones
    and those with nulls included.
    """
    extra = [c for c in left.columns if c not in (*keys, cutoff)]
    early = -F.unix_micros(F.col(filed).cast("timestamp"))
    own = F.struct(F.col(order).alias("order"), early.alias("early"), F.col(value).alias("value"))
    r = right.where(F.col(filed).isNotNull() & F.col(order).isNotNull())
    r = r.select(*keys, F.col(filed).alias("_at"), F.lit(1).alias("_side"), own.alias("_own"))
    kinds = {f.name: f.dataType for f in left.schema.fields}
    both = r.select("*", *[F.lit(None).cast(kinds[c]).alias(c) for c in extra]).unionByName(
        left.select(*keys, F.col(cutoff).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(r.schema["_own"].dataType).alias("_own"), *extra)
    )
    seen = running(both, keys, [F.col("_at"), F.col("_side")], {"_best": ("max", F.col("_own"))}, is_hot(both, keys, limit)).where("_side = 0")
    known = reduce(Column.__and__, [F.col(k).isNotNull() for k in keys]) & F.col("_at").isNotNull()  # a null key or cutoff matches nothing
    best = F.when(known, F.col("_best"))
    return seen.select(*keys, F.col("_at").alias(cutoff), *extra, best["order"].alias(order), best["value"].alias(value)).select(*left.columns, order, value)


def first_filed(points: DataFrame, keys: list[str], end: str, filed: str) -> DataFrame:
    """One row for each key and end: the one filed first."""
    w = Window.partitionBy(*keys, end).orderBy(filed)
    return points.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def periods_back(left: DataFrame, points: DataFrame, keys: list[str], cutoff: str, filed: str, end: str, value: str, n: int, limit: int | None = None) -> DataFrame:
    """left with the value whose end-year is n before the latest known end-year, as of the cutoff.

    Two running maxima: the latest known year, then the greatest end of the year
    that is asked for (of equals, the earliest filed).
    """
    years = points.withColumns({"_year": F.year(end), "_end": F.col(end)})
    latest = asof_by(left, years.withColumn("_none", F.lit(0)), keys, cutoff, filed, "_year", "_none", limit).drop("_none")
    asked = latest.withColumn("_year", F.col("_year") - n)
    return asof_by(asked, years, [*keys, "_year"], cutoff, filed, "_end", value, limit).select(*left.columns, value)


def first_known(columns: list[Column]) -> Column:
    """The first non-null in order of priority."""
    return F.coalesce(*columns)


def members_at(today: DataFrame, changes: DataFrame, cutoffs: list) -> DataFrame:
    """(cutoff, ticker): who was a member at each cutoff of a list.

    today(ticker); changes(ticker, when, op) with op add or remove. A ticker's
    first change after the cutoff tells: removed then means a member before, added
    then means none; without one, today's state holds. On one day a removal counts
    before an addition.
    """
    each = F.explode(F.array(*[F.lit(c) for c in cutoffs])).alias("cutoff")
    later = changes.select("ticker", "when", "op", each).where(F.col("when") > F.col("cutoff"))
    first = later.groupBy("cutoff", "ticker").agg(F.min(F.struct("when", (F.col("op") == "add").cast("int").alias("added"))).alias("first"))
    stable = today.select("ticker", each).join(first, ["cutoff", "ticker"], "left_anti").select("cutoff", "ticker")
    return first.where("first.added = 0").select("cutoff", "ticker").unionByName(stable).distinct()
