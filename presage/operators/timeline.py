"""Running values and row offsets over timelines, whatever the rows of a key.

A key's timeline is a sort in one task as long as its rows, which are counted,
are few enough. Beyond, timelines are cut into ranges of (key, order): running
values are made range by range, and each range takes up the last state of those
before it; a value so many rows away is met by its place, which the ranges' sizes
give. Results are the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from presage.operators.ranking import _same, grouped_rank
from presage.operators.staging import materialize

#: Rows of a key that one task sorts.
ROWS = 2_000_000


def is_hot(df: DataFrame, keys: list[str], limit: int | None = None) -> bool:
    """Whether a key has more rows than one task should sort."""
    [row] = df.groupBy(*keys).count().agg(F.max("count").alias("n")).collect()
    return (row["n"] or 0) > (ROWS if limit is None else limit)


def _over(how: str, x: Column, window: Window) -> Column:
    return (F.last(x, ignorenulls=True) if how == "last" else F.max(x) if how == "max" else F.sum(x)).over(window)


def running(df: DataFrame, keys: list[str], order: list[Column], specs: dict[str, tuple[str, Column]], hot: bool) -> DataFrame:
    """df with, for each name: (how, x), the last known, greatest or summed x ("last", "max", "sum") of the key's rows up to this one."""
    upto = (Window.unboundedPreceding, 0)
    if not hot:
        line = Window.partitionBy(*keys).orderBy(*order).rowsBetween(*upto)
        return df.withColumns({name: _over(how, x, line) for name, (how, x) in specs.items()})
    named = df.withColumns({f"_x_{name}": x for name, (_, x) in specs.items()})
    salt = F.xxhash64(*[c for c, kind in df.dtypes if not kind.startswith("map")])
    by = [*[F.col(k) for k in keys], *order, salt]
    dealt = named.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_row", F.monotonically_increasing_id())
    dealt = materialize(dealt, "ranges").withColumn("_part", F.shiftrightunsigned("_row", 33))
    parts = ["_part", *keys]
    inner = Window.partitionBy(*parts).orderBy("_row").rowsBetween(*upto)
    local = dealt.withColumns({f"_l_{name}": _over(how, F.col(f"_x_{name}"), inner) for name, (how, _) in specs.items()})
    # What a range leaves to the next ones.
    state = {"last": lambda x: F.max_by(x, F.when(x.isNotNull(), F.col("_row"))), "max": F.max, "sum": F.sum}
    ends = dealt.groupBy(*parts).agg(*[state[how](F.col(f"_x_{name}")).alias(f"_e_{name}") for name, (how, _) in specs.items()])
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*parts, *[_over(how, F.col(f"_e_{name}"), before).alias(f"_c_{name}") for name, (how, _) in specs.items()])
    met = local.alias("l").join(ends.alias("r"), _same("l", "r", parts))
    out = []
    for name, (how, _) in specs.items():
        own, past = F.col(f"l._l_{name}"), F.col(f"r._c_{name}")
        both = own if how == "last" else own + past if how == "sum" else F.when(past > own, past).otherwise(own)
        out.append((F.coalesce(own, past) if how == "last" else F.coalesce(both, own, past)).alias(name))
    return met.select(*[F.col(f"l.{c}") for c in df.columns], *out)


def shifted(df: DataFrame, keys: list[str], order: list[Column], specs: dict[str, tuple[Column, int]], hot: bool) -> DataFrame:
    """df with, for each name: (x, offset), x of the row so many places on (before, if negative); null where there is none."""
    if not hot:
        line = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumns({name: F.lead(x, n).over(line) for name, (x, n) in specs.items()})
    named = df.withColumns({f"_x_{name}": x for name, (x, _) in specs.items()})
    placed = materialize(grouped_rank(named, keys, order, "_place"), "places")
    # A row sends its values to the places that ask for them.
    sends = F.explode(F.array(*[F.struct(F.lit(i).alias("slot"), (F.col("_place") - n).alias("at")) for i, (_, n) in enumerate(specs.values())]))
    sent = placed.select(*keys, sends.alias("_s"), *[f"_x_{name}" for name in specs]).where("_s.at >= 1")
    given = [F.max(F.when(F.col("_s.slot") == i, F.struct(F.col(f"_x_{name}").alias("v")))).getField("v").alias(name) for i, name in enumerate(specs)]
    given = sent.groupBy(*keys, F.col("_s.at").alias("_place")).agg(*given)
    met = placed.alias("l").join(given.alias("r"), _same("l", "r", [*keys, "_place"]), "left")
    return met.select(*[F.col(f"l.{c}") for c in df.columns], *[F.col(f"r.{name}") for name in specs])
