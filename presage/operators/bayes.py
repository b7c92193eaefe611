"""Naive Bayes over categorical features: prediction, cross-validation in one pass, explanation, metrics.

A model is its count table: a row for each (fold, class, field, value). Up to
BOUND rows it is brought to the driver and scoring is one stage: each feature is
looked up by (fold, value) in a table of that size, which Spark broadcasts, and a
row's sums are columns. A larger table stays where it is; then rows are taken
apart by feature, joined and summed by id.
"""

from __future__ import annotations

import math
from collections import defaultdict
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from presage.functions.text import category
from presage.operators.lift import unpivot
from presage.operators.ranking import grouped_rank
from presage.operators.staging import local_rows

ALPHA = 1.0
#: Rows of a count table that the driver takes.
BOUND = 100_000


def stratified_fold(df: DataFrame, label: str, key: str, k: int = 5, out: str = "fold") -> DataFrame:
    """df with a fold from 0: position within the class in order of key, modulo k."""
    return grouped_rank(df, [label], [F.col(key)], "_place").withColumn(out, ((F.col("_place") - 1) % k).cast("int")).drop("_place")


def _local(spark: SparkSession, rows: list[tuple], kinds: dict[str, pa.DataType]) -> DataFrame:
    """Rows of the driver as a relation whose size the optimizer knows: of at most BOUND rows, so it is broadcast."""
    return F.broadcast(local_rows(spark, rows, kinds))


class Counts:
    """A count table on the driver: what smoothed probabilities need, for each held-out fold.

    Training counts of a fold are all counts less its own; fold None is one model
    of all rows.
    """

    def __init__(self, rows: list, features: list[str], classes: list[str], folds: list[int] | None, alpha: float):
        self.features, self.classes, self.folds, self.alpha = features, classes, folds if folds is not None else [None], alpha
        zero = lambda: [0] * len(classes)
        own, total = defaultdict(zero), defaultdict(zero)
        place = {c: i for i, c in enumerate(classes)}
        for fold, cls, field, value, n in rows:
            if cls in place:
                own[fold, field, value][place[cls]] += n
                total[field, value][place[cls]] += n
        self.values: dict[tuple, list[int]] = {}
        for f in self.folds:
            for (field, value), n in total.items():
                self.values[f, field, value] = n if f is None else [a - b for a, b in zip(n, own.get((f, field, value), zero()))]
        self.sizes = {f: self.values.get((f, None, None), zero()) for f in self.folds}
        seen = defaultdict(int)
        for (f, field, _), n in self.values.items():
            seen[f, field] += sum(n) > 0
        self.seen = seen

    def prior(self, fold: int | None) -> list[float]:
        n, k = sum(self.sizes[fold]), len(self.classes)
        return [math.log((c + self.alpha) / (n + self.alpha * k)) for c in self.sizes[fold]]

    def likelihoods(self, fold: int | None, field: str, value: str | None) -> list[float]:
        """log P(value | class) for each class; a value without training rows has count 0."""
        counts = self.values.get((fold, field, value), [0] * len(self.classes))
        return [math.log((n + self.alpha) / (c + self.alpha * (self.seen[fold, field] + 1))) for n, c in zip(counts, self.sizes[fold])]

    def table(self, spark: SparkSession, i: int) -> DataFrame:
        """(_f, _v, _l{i}_{c}...): the i-th field's values and their log-likelihoods, a column a class."""
        field = self.features[i]
        rows = [(f, v, *self.likelihoods(f, field, v)) for f, g, v in self.values if g == field]
        return _local(spark, rows, {"_f": pa.int32(), "_v": pa.string()} | {f"_l{i}_{c}": pa.float64() for c in range(len(self.classes))})

    def defaults(self, spark: SparkSession) -> DataFrame:
        """(_f, _q_{c}..., _u{i}_{c}...): for each fold the log priors, and each field's log-likelihoods of an unseen value."""
        k, n = len(self.classes), len(self.features)
        rows = [(f, *self.prior(f), *[x for g in self.features for x in self.likelihoods(f, g, None)]) for f in self.folds]
        names = [f"_q_{c}" for c in range(k)] + [f"_u{i}_{c}" for i in range(n) for c in range(k)]
        return _local(spark, rows, {"_f": pa.int32()} | {x: pa.float64() for x in names})


def counted(base: DataFrame, features: list[str]) -> DataFrame:
    """(fold, cls, field, value, n) of base(fold, cls, features); field null: the class itself."""
    parts = [F.struct(F.lit(f).alias("field"), category(F.col(f)).alias("value")) for f in features]
    whole = F.struct(F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("value"))
    long = base.select("fold", "cls", F.explode(F.array(whole, *parts)).alias("_p")).select("fold", "cls", "_p.field", "_p.value")
    return long.groupBy("fold", "cls", "field", "value").agg(F.count("*").alias("n"))


def fit(base: DataFrame, features: list[str], classes: list[str] | None, folds: list[int] | None = None, alpha: float = ALPHA, bound: int | None = None) -> Counts | None:
    """The counts of base(fold if folds, cls, features); None if they are over the bound. classes None: those there are, in order."""
    base = base if folds is not None else base.withColumn("fold", F.lit(None).cast("int"))
    limit = BOUND if bound is None else bound
    rows = [tuple(r) for r in counted(base.where(F.col("cls").isNotNull()), features).limit(limit + 1).collect()]
    if len(rows) > limit:
        return None
    names = classes if classes is not None else sorted({r[1] for r in rows})
    return Counts(rows, features, names, folds, alpha)


def fit_stated(base: DataFrame, stated: dict[str, str], classes: list[str], alpha: float = ALPHA) -> Counts:
    """The part of the counts of base(cls, features) that says all about one row of stated values, whatever the size of the whole.

    That is each stated value's row, the classes' sizes, and how many values each feature has.
    """
    counts = counted(base.where(F.col("cls").isNotNull()).withColumn("fold", F.lit(None).cast("int")), list(stated))
    told = reduce(Column.__or__, [(F.col("field") == f) & (F.col("value") == v) for f, v in stated.items()], F.col("field").isNull())
    rows = [tuple(r) for r in counts.where(told).collect()]  # a row a class for each feature
    model = Counts(rows, list(stated), classes, None, alpha)
    sizes = counts.where("field is not null").select("field", "value").distinct().groupBy("field").agg(F.count("*").alias("v")).collect()
    model.seen.update({(None, r["field"]): r["v"] for r in sizes})
    return model


def _scores(df: DataFrame, model: Counts, sets: dict[int | str, list[int]]) -> DataFrame:
    """df(fold, features) with p{n} for each n of sets: the probabilities by the features at those places, as an array over classes.

    Each look-up is a join with a table on the driver; sums, their maximum and the
    exponentials are projections of their own, so that none is computed twice.
    """
    spark, k, names = df.sparkSession, len(model.classes), df.columns
    folded = model.folds != [None]

    def with_fold(other: DataFrame, on: Column, how: str) -> DataFrame:
        on = on & (F.col("l.fold") == F.col("r._f")) if folded else on
        return df.alias("l").join(other.alias("r"), on, how).drop("_f")

    df = with_fold(model.defaults(spark), F.lit(True), "inner")
    for i, f in enumerate(model.features):
        df = with_fold(model.table(spark, i), category(F.col(f"l.{f}")) == F.col("r._v"), "left").drop("_v")
    for n, places in sets.items():
        own = lambda i, c: F.coalesce(f"_l{i}_{c}", f"_u{i}_{c}")
        df = df.withColumns({f"_s{n}_{c}": sum((own(i, c) for i in places), F.col(f"_q_{c}")) for c in range(k)})
    tops = {f"_t{n}": F.greatest(*[F.col(f"_s{n}_{c}") for c in range(k)]) if k > 1 else F.col(f"_s{n}_0") for n in sets}
    df = df.withColumns(tops).withColumns({f"_e{n}_{c}": F.exp(F.col(f"_s{n}_{c}") - F.col(f"_t{n}")) for n in sets for c in range(k)})
    df = df.withColumns({f"_w{n}": sum((F.col(f"_e{n}_{c}") for c in range(1, k)), F.col(f"_e{n}_0")) for n in sets})
    return df.select(*names, *[F.array(*[F.col(f"_e{n}_{c}") / F.col(f"_w{n}") for c in range(k)]).alias(f"p{n}") for n in sets])


def _log_likelihoods(base: DataFrame, features: list[str], classes: list[str], folds: list[int] | None, alpha: float) -> DataFrame:
    """(fold, field, value, ll): for each held-out fold and every value known anywhere, log P(value | class) as an array over classes.

    Training counts are all counts less the fold's own. folds None: one model, fold -1, trained on all of base.
    """
    k = len(classes)
    u = unpivot(base, ["fold", "cls"], features, missing=True)
    per_class = [F.sum((F.col("cls") == c).cast("long")).alias(f"n{i}") for i, c in enumerate(classes)]
    own = u.groupBy("fold", "field", "value").agg(*per_class)
    total = own.groupBy("field", "value").agg(*[F.sum(f"n{i}").alias(f"t{i}") for i in range(k)])
    n_own = base.groupBy("fold").agg(*[F.sum((F.col("cls") == c).cast("long")).alias(f"c{i}") for i, c in enumerate(classes)])
    if folds is None:
        grid = total.select(F.lit(-1).alias("fold"), "field", "value", *[F.col(f"t{i}").alias(f"n{i}") for i in range(k)])
        sizes = base.agg(*[F.sum((F.col("cls") == c).cast("long")).alias(f"c{i}") for i, c in enumerate(classes)]).withColumn("fold", F.lit(-1))
    else:
        each = F.explode(F.array(*[F.lit(f) for f in folds])).alias("fold")
        grid = total.select("*", each).join(own, ["fold", "field", "value"], "left").select(
            "fold", "field", "value", *[(F.col(f"t{i}") - F.coalesce(f"n{i}", F.lit(0))).alias(f"n{i}") for i in range(k)]
        )
        all_ = n_own.agg(*[F.sum(f"c{i}").alias(f"a{i}") for i in range(k)])
        sizes = all_.select("*", each).join(n_own, "fold", "left").select(
            "fold", *[(F.col(f"a{i}") - F.coalesce(f"c{i}", F.lit(0))).alias(f"c{i}") for i in range(k)]
        )
    seen = sum((F.col(f"n{i}") for i in range(1, k)), F.col("n0")) > 0
    values = grid.where(seen).groupBy("fold", "field").agg(F.count("*").alias("v"))
    n = sum((F.col(f"c{i}") for i in range(1, k)), F.col("c0"))
    prior = F.array(*[F.ln((F.col(f"c{i}") + alpha) / (n + alpha * k)) for i in range(k)])
    sizes = sizes.withColumn("prior", prior)
    ll = F.array(*[F.ln((F.col(f"n{i}") + alpha) / (F.col(f"c{i}") + alpha * (F.col("v") + 1))) for i in range(k)])
    train = F.array(*[F.col(f"n{i}") for i in range(k)])
    return grid.join(values, ["fold", "field"]).join(sizes, "fold").select("fold", "field", "value", ll.alias("ll"), "prior", train.alias("counts"), "v", F.array(*[F.col(f"c{i}") for i in range(k)]).alias("sizes"))


def _softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    e = F.transform(scores, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def _score(test: DataFrame, features: list[str], classes: list[str], table: DataFrame, alpha: float, closed: bool = False) -> DataFrame:
    """(id, fold, cls, p array) of test(id, fold, cls, features).

    closed: every value of test is in the table, as in cross-validation; then the
    small table is read once. Otherwise a value without training rows takes the
    formula at count 0 from its field's facts.
    """
    k = len(classes)
    u = unpivot(test, ["id", "fold", "cls"], features, missing=True)
    if closed:
        joined = u.join(table.select("fold", "field", "value", "ll", "prior"), ["fold", "field", "value"])
    else:
        facts = table.select("fold", "field", "v", "sizes", "prior").distinct()
        zero = F.transform("sizes", lambda c: F.ln(F.lit(alpha) / (c + alpha * (F.col("v") + 1))))
        joined = u.join(table.select("fold", "field", "value", "ll"), ["fold", "field", "value"], "left")
        joined = joined.join(facts, ["fold", "field"]).withColumn("ll", F.coalesce("ll", zero))
    # A row's fold has one prior; its k log-likelihoods are summed as k numbers with map-side combination.
    sums = joined.groupBy("id", "fold", "cls").agg(*[F.sum(F.col("ll")[i]).alias(f"s{i}") for i in range(k)], *[F.max(F.col("prior")[i]).alias(f"q{i}") for i in range(k)])
    return sums.select("id", "fold", "cls", _softmax(F.array(*[F.col(f"s{i}") + F.col(f"q{i}") for i in range(k)])).alias("p"))


def long(scored: DataFrame, classes: list[str]) -> DataFrame:
    """(id, c, p): a row for each class."""
    pairs = F.arrays_zip(F.array(*[F.lit(c) for c in classes]).alias("c"), F.col("p").alias("p"))
    return scored.select("id", F.explode(pairs).alias("x")).select("id", "x.c", "x.p")


def predict(train: DataFrame, test: DataFrame, features: list[str], classes: list[str], alpha: float = ALPHA, bound: int | None = None) -> DataFrame:
    """Probabilities of test(id, cls, features) from train(cls, features)."""
    model = fit(train, features, classes, None, alpha, bound)
    if model:
        return apply(test.withColumn("fold", F.lit(-1)), model)
    table = _log_likelihoods(train.withColumn("fold", F.lit(-1)), features, classes, None, alpha)
    return _score(test.withColumn("fold", F.lit(-1)), features, classes, table, alpha)


def apply(test: DataFrame, model: Counts) -> DataFrame:
    """(id, fold, cls, p) of test(id, fold, cls, features) under a model of the driver, in one stage."""
    n = len(model.features)
    return _scores(test.select("id", "fold", "cls", *model.features), model, {n: list(range(n))}).select("id", "fold", "cls", F.col(f"p{n}").alias("p"))


def cross_validate(
    base: DataFrame, features: list[str], classes: list[str], folds: list[int], alpha: float = ALPHA, bound: int | None = None
) -> DataFrame:
    """Held-out probabilities of base(id, fold, cls, features); all folds are trained in one pass."""
    model = fit(base, features, classes, folds, alpha, bound)
    if model:
        return apply(base.where(F.col("fold").isin(folds)), model)
    return _score(base, features, classes, _log_likelihoods(base, features, classes, folds, alpha), alpha, closed=True)


def cross_validate_clustered(
    base: DataFrame, clusters: dict[str, list[str]], classes: list[str], folds: list[int], beta: float = 0.0, alpha: float = ALPHA, bound: int | None = None
) -> DataFrame:
    """Held-out probabilities of base(id, fold, cls, a level column a cluster, features): clusters vote once.

    Each feature adds beta times what it says beyond its cluster's level:
    ln P(value | level, class) - ln P(value | level), smoothed like the rest.
    """
    themes = list(clusters)
    if not beta:
        return cross_validate(base.select("id", "fold", "cls", *themes), themes, classes, folds, alpha, bound)
    pair = {f"{t}|{f}": F.concat_ws("|", category(F.col(t)), category(F.col(f))) for t, fields in clusters.items() for f in fields}
    wide = base.select("id", "fold", "cls", *[category(F.col(t)).alias(t) for t in themes], *[c.alias(n) for n, c in pair.items()])
    model = fit(wide, [*themes, *pair], classes, folds, alpha, bound)
    if model is None:
        return _large_residual(wide, themes, {n: t for t, fields in clusters.items() for n in (f"{t}|{f}" for f in fields)}, classes, folds, beta, alpha)
    residual = _Residual(model, clusters, beta)
    return apply(wide.where(F.col("fold").isin(folds)), residual)


def _large_residual(wide: DataFrame, themes: list[str], pairs: dict[str, str], classes: list[str], folds: list[int], beta: float, alpha: float) -> DataFrame:
    """cross_validate_clustered where the counts stay distributed: a pair's row meets its level's row, and rows are summed by id."""
    k = len(classes)
    table = _log_likelihoods(wide, [*themes, *pairs], classes, folds, alpha)
    own = F.col("field").isin(list(pairs))
    theme_of = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    levels = table.where(~own).select("fold", F.col("field").alias("theme"), F.col("value").alias("level"), F.col("counts").alias("of"))
    met = table.where(own).withColumns({"theme": F.element_at(theme_of, F.col("field")), "level": F.substring_index("value", "|", 1)})
    seen = F.aggregate("counts", F.lit(0).cast("long"), lambda a, b: a + b)
    some = met.where(seen > 0).groupBy("fold", "field").agg(F.count_distinct(F.expr("substring(value, length(level) + 2)")).alias("d"))
    met = met.join(levels, ["fold", "theme", "level"], "left").join(some, ["fold", "field"], "left")
    more = alpha * (F.coalesce("d", F.lit(0)) + 1)
    of = F.coalesce("of", F.array_repeat(F.lit(0).cast("long"), k))
    whole = F.ln((seen + alpha) / (F.aggregate(of, F.lit(0).cast("long"), lambda a, b: a + b) + more))
    residual = F.transform(F.arrays_zip(F.col("counts").alias("n"), of.alias("m")), lambda x: beta * (F.ln((x["n"] + alpha) / (x["m"] + more)) - whole))
    joint = table.where(~own).select("fold", "field", "value", "ll", "prior").unionByName(met.select("fold", "field", "value", residual.alias("ll"), "prior"))
    return _score(wide.where(F.col("fold").isin(folds)), [*themes, *pairs], classes, joint, alpha, closed=True)


class _Residual(Counts):
    """Counts whose paired features answer with beta times their residual."""

    def __init__(self, model: Counts, clusters: dict[str, list[str]], beta: float):
        self.__dict__.update(model.__dict__)
        self.beta, self.own = beta, {f"{t}|{f}": t for t, fields in clusters.items() for f in fields}
        distinct: dict[tuple, set] = defaultdict(set)
        for (f, field, value), n in self.values.items():
            if field in self.own and sum(n):
                distinct[f, field].add(value.partition("|")[2])
        self.distinct = {k: len(v) for k, v in distinct.items()}

    def likelihoods(self, fold: int | None, field: str, value: str | None) -> list[float]:
        if field not in self.own:
            return super().likelihoods(fold, field, value)
        counts = self.values.get((fold, field, value), [0] * len(self.classes))
        level = self.values.get((fold, self.own[field], (value or "").partition("|")[0]), [0] * len(self.classes))
        more = self.alpha * (self.distinct.get((fold, field), 0) + 1)
        whole = math.log((sum(counts) + self.alpha) / (sum(level) + more))
        return [self.beta * (math.log((n + self.alpha) / (m + more)) - whole) for n, m in zip(counts, level)]


def explain(train: DataFrame, test: DataFrame, features: list[str], classes: list[str], alpha: float = ALPHA, bound: int | None = None) -> DataFrame:
    """(id, c, field, value, lift): P(value | class) / P(value) of each of test's values, the factors of a prediction."""
    model = fit(train, features, classes, None, alpha, bound)
    if model:
        n = sum(model.sizes[None])
        rows = [(g, v, [math.exp(x) * n / sum(c) for x in model.likelihoods(None, g, v)]) for (_, g, v), c in model.values.items() if g]
        lifts = _local(train.sparkSession, rows, {"field": pa.string(), "value": pa.string(), "lifts": pa.list_(pa.float64())})
    else:
        table = _log_likelihoods(train.withColumn("fold", F.lit(-1)), features, classes, None, alpha)
        total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, b: a + b)
        n = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b)
        lifts = table.select("field", "value", F.transform("ll", lambda x: F.exp(x) / (total / n)).alias("lifts"))
    u = unpivot(test, ["id"], features, missing=True).join(lifts, ["field", "value"])
    pairs = F.arrays_zip(F.array(*[F.lit(c) for c in classes]).alias("c"), F.col("lifts").alias("lift"))
    return u.select("id", "field", "value", F.explode(pairs).alias("x")).select("id", "x.c", "field", "value", "x.lift")


def judged(scored: DataFrame, classes: list[str]) -> DataFrame:
    """scored with the true class's p, the top class and its p, and both ranks; of equals, the first class."""
    true = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("cls")).cast("int")
    top = F.array_position("p", F.array_max("p")).cast("int")
    return scored.select(
        "id", "fold", "cls", "p", (true - 1).alias("true_rank"), (top - 1).alias("pred_rank"), F.element_at("p", true).alias("p_true"), F.array_max("p").alias("conf")
    )


def metrics(scored: DataFrame, classes: list[str], good: list[str], bins: int = 10) -> DataFrame:
    """One row: n, logloss, accuracy, mean_conf, overconfidence, optimism, brier, ece."""
    j = judged(scored, classes)
    hit = (F.col("true_rank") == F.col("pred_rank")).cast("double")
    places = [classes.index(c) for c in good]
    p_good = sum((F.col("p")[i] for i in places[1:]), F.col("p")[places[0]])
    brier = F.aggregate(F.transform("p", lambda x, i: F.pow(x - (i == F.col("true_rank")).cast("double"), F.lit(2))), F.lit(0.0), lambda a, b: a + b)
    from presage.functions.buckets import equal_width_bin

    bin_ = j.withColumns({"hit": hit, "bin": equal_width_bin(F.col("conf"), bins), "good": p_good, "brier": brier})
    by = bin_.groupBy("bin").agg(
        F.count("*").alias("n"), F.sum("hit").alias("h"), F.sum("conf").alias("c"), F.sum(-F.ln(F.greatest(F.col("p_true"), F.lit(1e-12)))).alias("l"),
        F.sum("good").alias("g"), F.sum(F.col("cls").isin(good).cast("double")).alias("ag"), F.sum("brier").alias("b"),
    )
    n = F.sum("n")
    return by.agg(
        n.alias("n"), (F.sum("l") / n).alias("logloss"), (F.sum("h") / n).alias("accuracy"), (F.sum("c") / n).alias("mean_conf"),
        ((F.sum("c") - F.sum("h")) / n).alias("overconfidence"), ((F.sum("g") - F.sum("ag")) / n).alias("optimism"),
        (F.sum("b") / n).alias("brier"), (F.sum(F.abs(F.col("c") - F.col("h"))) / n).alias("ece"),
    )


def evaluate(scored: DataFrame, classes: list[str]) -> DataFrame:
    """One row: n, accuracy, base_accuracy, their difference, info_gain (bits) and its parts h and mxe, geom_mean_lift, mean_rank, base_mean_rank.

    The base distribution is the test rows' own class frequencies; ranks are from 0.
    """
    j = judged(scored, classes)
    rank = F.size(F.filter("p", lambda x: x > F.col("p_true")))
    counts = j.groupBy("cls").agg(
        F.count("*").alias("m"), F.sum((F.col("true_rank") == F.col("pred_rank")).cast("double")).alias("h"),
        F.sum(-F.log2(F.greatest(F.col("p_true"), F.lit(1e-12)))).alias("x"), F.sum(rank).alias("r"),
    )
    base = counts.withColumn("br", F.row_number().over(Window.orderBy(F.desc("m"), "cls")) - 1)  # a row a class
    n = F.sum("m")
    total = base.agg(
        n.alias("n"), (F.sum("h") / n).alias("accuracy"), (F.max("m") / n).alias("base_accuracy"), (F.sum("x") / n).alias("mxe"),
        (F.sum("r") / n).alias("mean_rank"), (F.sum(F.col("br") * F.col("m")) / n).alias("base_mean_rank"),
        F.sum(F.col("m") * F.log2("m")).alias("mlogm"),
    )
    h = F.log2("n") - F.col("mlogm") / F.col("n")
    gain = h - F.col("mxe")
    return total.select(
        "n", "accuracy", "base_accuracy", (F.col("accuracy") - F.col("base_accuracy")).alias("accuracy_gain"), gain.alias("info_gain"), "mxe", h.alias("h"),
        F.pow(F.lit(2.0), gain).alias("geom_mean_lift"), "mean_rank", "base_mean_rank",
    )


def prefix_scores(
    base: DataFrame, ranked: list[str], classes: list[str], folds: list[int], sizes: list[int], alpha: float = ALPHA, bound: int | None = None
) -> DataFrame:
    """(k, n, logloss, accuracy): held-out quality of the first k ranked features, all k in one pass."""
    k, model = len(classes), fit(base, ranked, classes, folds, alpha, bound)
    if model:
        found = _scores(base.where(F.col("fold").isin(folds)).select("id", "fold", "cls", *ranked), model, {n: list(range(n)) for n in sizes})
        each = F.array(*[F.struct(F.lit(n).alias("k"), F.col(f"p{n}").alias("p")) for n in sizes])
        scored = found.select("id", "fold", "cls", F.explode(each).alias("x")).select("id", "fold", "cls", "x.k", "x.p")
    else:
        scored = _large_prefixes(base, ranked, classes, folds, sizes, alpha)
    true = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("cls")).cast("int")
    top = F.array_position("p", F.array_max("p")).cast("int")
    return scored.groupBy("k").agg(
        F.count("*").alias("n"), F.avg(-F.ln(F.greatest(F.element_at("p", true), F.lit(1e-12)))).alias("logloss"), F.avg((true == top).cast("double")).alias("accuracy")
    )


def _large_prefixes(base: DataFrame, ranked: list[str], classes: list[str], folds: list[int], sizes: list[int], alpha: float) -> DataFrame:
    k = len(classes)
    table = _log_likelihoods(base, ranked, classes, folds, alpha)
    u = unpivot(base, ["id", "fold", "cls"], ranked, missing=True)
    place = F.array_position(F.array(*[F.lit(f) for f in ranked]), F.col("field"))
    each = u.join(table.select("fold", "field", "value", "ll", "prior"), ["fold", "field", "value"]).withColumn("place", place)
    each = each.withColumn("k", F.explode(F.filter(F.array(*[F.lit(s) for s in sizes]), lambda s: s >= F.col("place"))))
    sums = each.groupBy("id", "fold", "cls", "k").agg(*[F.sum(F.col("ll")[i]).alias(f"s{i}") for i in range(k)], *[F.max(F.col("prior")[i]).alias(f"q{i}") for i in range(k)])
    return sums.select("id", "fold", "cls", "k", _softmax(F.array(*[F.col(f"s{i}") + F.col(f"q{i}") for i in range(k)])).alias("p"))


def subset_scores(
    base: DataFrame, features: list[str], sets: dict[str, list[str]], classes: list[str], folds: list[int], alpha: float = ALPHA, bound: int | None = None, keep: list[str] | None = None
) -> DataFrame:
    """(id, fold, cls, keep..., p_{name} for each name of sets): held-out probabilities by several sets of features, from one count and one scan."""
    keep, model = keep or [], fit(base, features, classes, folds, alpha, bound)
    rows = base.where(F.col("fold").isin(folds))
    if model:
        found = _scores(rows.select("id", "fold", "cls", *keep, *features), model, {f"_{name}": [features.index(x) for x in own] for name, own in sets.items()})
        return found.select("id", "fold", "cls", *keep, *[f"p_{name}" for name in sets])
    k = len(classes)
    table = _log_likelihoods(base, features, classes, folds, alpha)
    joined = unpivot(rows, ["id", "fold", "cls"], features, missing=True).join(table.select("fold", "field", "value", "ll", "prior"), ["fold", "field", "value"])
    part = lambda own, i: F.sum(F.when(F.col("field").isin(own), F.col("ll")[i]).otherwise(0.0))
    sums = joined.groupBy("id", "fold", "cls").agg(F.max("prior").alias("prior"), *[F.array(*[part(own, i) for i in range(k)]).alias(f"s_{name}") for name, own in sets.items()])
    probs = [_softmax(F.zip_with(f"s_{name}", "prior", lambda a, b: a + b)).alias(f"p_{name}") for name in sets]
    out = sums.select("id", "fold", "cls", *probs)
    return out.join(rows.select("id", *keep), "id") if keep else out


def rank_features(base: DataFrame, features: list[str], classes: list[str], folds: list[int], alpha: float = ALPHA, bound: int | None = None) -> DataFrame:
    """(field, n, logloss, gain), most telling first: each single feature's held-out log loss, and how far it is below the class shares'.

    What one feature says of a row depends on its value and fold alone, so the
    losses are sums over the count table: the rows are read once, to count them.
    Of equal gains the first name comes first.
    """
    model = fit(base, features, classes, folds, alpha, bound)
    kinds = "field string, n bigint, logloss double, gain double"
    if model:
        total = {(field, value): n for (_, field, value), n in _totals(model).items()}
        out = []
        base_loss, m = _loss(model, None, total)
        for field in features:
            loss, n = _loss(model, field, total)
            out.append((field, n, loss / n if n else None, base_loss / m - loss / n if n else None))
        return base.sparkSession.createDataFrame(sorted(out, key=lambda r: (-(r[3] or 0.0), r[0])), kinds)
    table = _log_likelihoods(base, features, classes, folds, alpha)
    own = unpivot(base, ["fold", "cls"], features, missing=True).groupBy("fold", "field", "value", "cls").agg(F.count("*").alias("n"))
    place = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("cls")).cast("int")
    sums = F.transform(F.arrays_zip(F.col("ll").alias("a"), F.col("prior").alias("b")), lambda x: x["a"] + x["b"])
    met = own.where(F.col("cls").isin(classes)).join(table, ["fold", "field", "value"])
    met = met.withColumns({"_p": F.element_at(_softmax(sums), place), "_q": F.element_at(_softmax(F.col("prior")), place)})
    loss = lambda p: F.sum(-F.col("n") * F.ln(F.greatest(F.col(p), F.lit(1e-12)))) / F.sum("n")
    found = met.groupBy("field").agg(F.sum("n").alias("n"), loss("_p").alias("logloss"), (loss("_q") - loss("_p")).alias("gain"))
    return found.orderBy(F.desc("gain"), "field")


def _totals(model: Counts) -> dict[tuple, list[int]]:
    """The counts of all rows: with k held-out folds, each count is left out of one, so the sum over folds has it k - 1 times."""
    out: dict[tuple, list[int]] = {}
    for (_, field, value), n in model.values.items():
        key = (None, field, value)
        out[key] = [a + b for a, b in zip(out.get(key, [0] * len(n)), n)]
    k = len(model.folds) - 1
    return {key: [x // k for x in n] for key, n in out.items()}


def _loss(model: Counts, field: str | None, total: dict[tuple, list[int]]) -> tuple[float, int]:
    """(sum of -ln p of the true class, rows) by one feature, or by the class shares alone."""
    loss, rows = 0.0, 0
    values = [v for f, v in total if f == field]
    for fold in model.folds:
        prior = model.prior(fold)
        for value in values:
            own = [a - b for a, b in zip(total[field, value], model.values[fold, field, value])]
            if not any(own):
                continue
            scores = [p + x for p, x in zip(prior, model.likelihoods(fold, field, value))] if field is not None else prior
            top = max(scores)
            whole = sum(math.exp(s - top) for s in scores)
            loss -= sum(n * math.log(max(math.exp(s - top) / whole, 1e-12)) for n, s in zip(own, scores))
            rows += sum(own)
    return loss, rows


def peak(sweep: DataFrame) -> DataFrame:
    """The k of least log loss, the smallest of equals: one row of a sweep."""
    return sweep.orderBy("logloss", "k").limit(1)


def with_fallback(p: DataFrame, priors: DataFrame, classes: list[str]) -> DataFrame:
    """(id, p): probabilities that sum to 1; rows without any take the priors, all-zero ones are uniform."""
    total = F.aggregate("p", F.lit(0.0), lambda a, b: a + b)
    own = p.crossJoin(F.broadcast(priors.select(F.col("p").alias("prior"))))  # one row
    own = own.withColumn("p", F.coalesce("p", "prior"))
    return own.select("id", F.when(total > 0, F.transform("p", lambda x: x / total)).otherwise(F.array_repeat(F.lit(1.0 / len(classes)), len(classes))).alias("p"))
