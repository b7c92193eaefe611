"""Mutual information of features, MDL gains, clusters of correlated features and their themes."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from presage.functions.buckets import level
from presage.functions.text import category
from presage.operators.lift import unpivot
from presage.operators.ranking import quantiles
from presage.operators.staging import materialize


#: Features beyond which value pairs are counted by matrices, and rows that these are made of.
WIDE, STRIDE = 8, 1 << 16


def pair_counts(df: DataFrame, features: list[str], wide: int = WIDE) -> DataFrame:
    """(fa, fb, va, vb, n): how many rows have values va and vb of features fa and fb.

    Few features: a row is taken apart into its pairs. Many, since the pairs grow
    with their square: each task codes the columns of some thousands of rows, counts
    every pair's codes at once, and emits the cells that are not empty. Either way
    the cells are added up before they are shuffled, so what is shuffled does not
    grow with the rows.
    """
    cat = {f: category(F.col(f)) for f in features}
    if len(features) <= wide:
        pairs = [F.struct(F.lit(a).alias("fa"), F.lit(b).alias("fb"), cat[a].alias("va"), cat[b].alias("vb")) for a, b in combinations(features, 2)]
        return df.select(F.explode(F.array(*pairs)).alias("x")).select("x.*").groupBy("fa", "fb", "va", "vb").agg(F.count("*").alias("n"))

    def cells(table: pa.Table) -> Iterator[pa.RecordBatch]:
        coded = [table.column(i).combine_chunks().dictionary_encode() for i in range(len(features))]
        codes = [c.indices.to_numpy().astype(np.int64) for c in coded]
        names = [c.dictionary.to_pylist() for c in coded]
        for a in range(len(features) - 1):
            out: list[list] = [[], [], [], [], []]
            for b in range(a + 1, len(features)):
                k = len(names[b])
                both = codes[a] * k + codes[b]
                if len(names[a]) * k <= 4 * STRIDE:
                    n = np.bincount(both)
                    at = np.flatnonzero(n)
                    n = n[at]
                else:
                    at, n = np.unique(both, return_counts=True)
                out[0] += [features[a]] * len(at)
                out[1] += [features[b]] * len(at)
                out[2] += [names[a][i] for i in (at // k).tolist()]
                out[3] += [names[b][i] for i in (at % k).tolist()]
                out[4] += n.tolist()
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.string()) for x in out[:4]), pa.array(out[4], pa.int64())], ["fa", "fb", "va", "vb", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= STRIDE:
                yield from cells(pa.Table.from_batches(held))
                held, size = [], 0
        if size:
            yield from cells(pa.Table.from_batches(held))

    found = df.select(*[c.alias(f"x{i}") for i, c in enumerate(cat.values())]).mapInArrow(run, "fa string, fb string, va string, vb string, n bigint")
    return found.groupBy("fa", "fb", "va", "vb").agg(F.sum("n").alias("n"))


def mutual_information(df: DataFrame, features: list[str]) -> DataFrame:
    """(fa, fb, n, mi, nmi, mdl_gain) for each pair of features, from one count of value pairs.

    mi in nats; nmi = mi / sqrt(Ha Hb), 0 if that divisor is 0; mdl_gain =
    n mi / ln 2 - (|A| - 1)(|B| - 1) log2(n) / 2. Missing values are a category.
    """
    counts = pair_counts(df, features)
    # The cells of a pair of features are few; their marginals are windows over them.
    by = lambda *c: Window.partitionBy("fa", "fb", *c)
    cells = counts.select(
        "*", F.sum("n").over(by("va")).alias("na"), F.sum("n").over(by("vb")).alias("nb"), F.sum("n").over(by()).alias("t"),
        F.row_number().over(by("va").orderBy("vb")).alias("ra"), F.row_number().over(by("vb").orderBy("va")).alias("rb"),
    )
    n, t = F.col("n") / F.col("t"), F.col("t")
    entropy = lambda m: -(F.col(m) / t) * F.ln(F.col(m) / t)
    sums = cells.groupBy("fa", "fb").agg(
        F.max("t").alias("n"),
        F.greatest(F.sum(n * F.ln(F.col("n") * t / (F.col("na") * F.col("nb")))), F.lit(0.0)).alias("mi"),
        F.sum(F.when(F.col("ra") == 1, entropy("na"))).alias("ha"),
        F.sum(F.when(F.col("rb") == 1, entropy("nb"))).alias("hb"),
        F.sum((F.col("ra") == 1).cast("long")).alias("ka"),
        F.sum((F.col("rb") == 1).cast("long")).alias("kb"),
    )
    root = F.sqrt(F.col("ha") * F.col("hb"))
    gain = F.col("n") * F.col("mi") / F.lit(0.6931471805599453) - 0.5 * (F.col("ka") - 1) * (F.col("kb") - 1) * F.log2("n")
    return sums.select("fa", "fb", "n", "mi", F.when(root > 0, F.col("mi") / root).otherwise(0.0).alias("nmi"), gain.alias("mdl_gain"))


#: NMI that features of one cluster have at least.
NMI_FLOOR = 0.30


def cluster_features(df: DataFrame, features: list[str], linkage: str = "complete", min_nmi: float = NMI_FLOOR) -> list[list[str]]:
    """Clusters of features, largest first and then by name: the closest two merge while the MDL still gains.

    The pair table, a row for each two features, comes from Spark. A merge
    updates the table: with complete linkage the union is as near to another
    cluster as the farther part, with average linkage as both parts weighted by
    their sizes. Of equally near pairs the one whose features come first merges.
    """
    place = {f: i for i, f in enumerate(features)}
    near = {tuple(sorted((place[r["fa"]], place[r["fb"]]))): (r["nmi"], r["mdl_gain"]) for r in mutual_information(df, features).collect()}
    members = {i: [f] for i, f in enumerate(features)}

    def union(x: tuple[float, float], y: tuple[float, float], m: int, n: int) -> tuple[float, float]:
        if linkage == "complete":
            return min(x[0], y[0]), min(x[1], y[1])
        return tuple((m * a + n * b) / (m + n) for a, b in zip(x, y))

    while fit := {p: v for p, v in near.items() if v[1] > 0 and v[0] >= min_nmi}:
        best = max(v[0] for v in fit.values())
        i, j = min(p for p, v in fit.items() if v[0] == best)
        m, n = len(members[i]), len(members[j])
        for o in members.keys() - {i, j}:
            to, gone = tuple(sorted((i, o))), tuple(sorted((j, o)))
            near[to] = union(near[to], near.pop(gone), m, n)
        del near[i, j]
        members[i] += members.pop(j)
    return sorted(members.values(), key=lambda c: (-len(c), c[0]))


def theme_encode(base: DataFrame, clusters: dict[str, list[str]], rank: str, folds: list[int] | None = None, levels: int = 4) -> DataFrame:
    """(id, theme, raw, level): each cluster as one ordinal feature.

    A value's score is the mean outcome rank of its training rows (other folds
    than the row's own if folds are given); a theme is the mean over its
    features; levels cut it at the training themes' quantiles.

    Rows with the same values of a cluster share its score, so scores and quantiles
    are made of the distinct values and their counts by fold; rows are read to count
    them and to look their own up.
    """
    spark = base.sparkSession
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("theme"), F.array(*[category(F.col(f)) for f in fields]).alias("values")) for t, fields in clusters.items()]))
    rows = base.select("id", "fold", F.col(rank).cast("double").alias("_rank"), each.alias("_t")).select("id", "fold", "_rank", "_t.*")
    cells = materialize(rows.groupBy("fold", "theme", "values").agg(F.count("*").alias("n"), F.sum("_rank").alias("s"), F.count("_rank").alias("m")), "cells")
    single = cells.select("fold", "theme", F.posexplode("values").alias("place", "value"), "s", "m")
    own = single.groupBy("fold", "theme", "place", "value").agg(F.sum("s").alias("s"), F.sum("m").alias("m"))
    total = own.groupBy("theme", "place", "value").agg(F.sum("s").alias("ts"), F.sum("m").alias("tm"))
    models = spark.createDataFrame([(f,) for f in (folds if folds is not None else [-1])], "model int")
    keys = ["model", "theme", "place", "value"]
    known = total.crossJoin(F.broadcast(models)).join(own.withColumnRenamed("fold", "model"), keys, "left")  # a row a fold
    means = known.select(*keys, F.try_divide(F.coalesce("ts", F.lit(0.0)) - F.coalesce("s", F.lit(0.0)), F.col("tm") - F.coalesce("m", F.lit(0))).alias("mean"))
    distinct = cells.select("theme", "values").distinct().select("theme", "values", F.posexplode("values").alias("place", "value"))
    raw = materialize(distinct.join(means, ["theme", "place", "value"]).groupBy("model", "theme", "values").agg(F.avg("mean").alias("raw")), "scores")
    train = cells.select("fold", "theme", "values", "n").join(raw, ["theme", "values"])
    edges = quantiles(train if folds is None else train.where("fold <> model"), ["model", "theme"], "raw", [i / levels for i in range(1, levels)], "edges", weight="n")
    table = raw.join(edges, ["model", "theme"]).select("model", "theme", "values", "raw", level(F.col("raw"), F.col("edges")).alias("level"))
    if folds is None:
        return rows.join(table, ["theme", "values"]).select("id", "fold", "theme", "raw", "level")
    return rows.join(table.withColumnRenamed("model", "fold"), ["fold", "theme", "values"]).select("id", "fold", "theme", "raw", "level")


def redundant_pairs(df: DataFrame, features: list[str], k: int = 12) -> DataFrame:
    """The k pairs of greatest NMI."""
    return mutual_information(df, features).orderBy(F.desc("nmi"), "fa", "fb").limit(k)


def shrunk_effects(df: DataFrame, fields: list[str], y: Column, weight: float = 10.0) -> DataFrame:
    """(field, value, n, effect): n / (n + weight) times how far the value's mean lies from the whole mean."""
    known = df.withColumn("_y", y).where(F.col("_y").isNotNull())
    g = known.agg(F.avg("_y").alias("g"))
    means = unpivot(known, ["_y"], fields, missing=True).groupBy("field", "value").agg(F.count("*").alias("n"), F.avg("_y").alias("m"))
    return means.crossJoin(F.broadcast(g)).select("field", "value", "n", (F.col("n") / (F.col("n") + weight) * (F.col("m") - F.col("g"))).alias("effect"))


def additive_scores(df: DataFrame, effects: DataFrame, key: str, fields: list[str], mean: float | Column) -> DataFrame:
    """(key, score): the whole mean and the sum of the effects of a row's values; an unknown value has no effect."""
    u = unpivot(df, [key], fields, missing=True).join(effects.select("field", "value", "effect"), ["field", "value"], "left")
    sums = u.groupBy(key).agg(F.coalesce(F.sum("effect"), F.lit(0.0)).alias("s"))
    return sums.select(key, ((mean if isinstance(mean, Column) else F.lit(mean)) + F.col("s")).alias("score"))
