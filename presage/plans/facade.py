"""A JSON query language over tables: predict, relate, match, similarity, search, evaluate.

A body names its table in `from` and its conditions in `where`; each query is one
Spark plan, but for the count tables of predict and match, which the engine keeps.
Conditions: equality; text terms (fields named in `text_fields`, alike in every
kind: the text has one of the stated terms, also as {"$has": ..}); {"$gt", "$gte",
"$lt", "$lte"}; {"$or": [..]}, {"$and": [..]}, {"$not": ..}; {"$has": v}; and
{"$on": {"prop": .., "on": ..}}, at the top or in $and, which restricts the
population to `on`. A null satisfies neither a condition nor its negation.

predict and match take each condition as evidence: an equality is its field's
value, a text one proposition a term, a range, $or or $not one proposition that
is true, and $and all of its parts. Numbers with decimals count as the decile of
their field. With {"config": {"ai": "high"}} conditions whose fields are
correlated are one proposition, that they hold together. `select` picks result
columns in every kind; "$why" among them asks for a prediction's factors.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from presage.functions.analysis import has_term, stated_terms, term_counts, terms
from presage.functions.buckets import quantile_bin
from presage.functions.text import category, keyword_signals
from presage.operators import bayes, information, lift, ranking
from presage.operators.count_store import snapshot_key
from presage.operators.staging import local_rows, one_row

KINDS = ("predict", "relate", "match", "similarity", "search", "evaluate")
_COMPARE = {"$gt": Column.__gt__, "$gte": Column.__ge__, "$lt": Column.__lt__, "$lte": Column.__le__, "$has": Column.__eq__}
#: Result columns by their names in `select`.
_SELECT = {"$p": "p", "$score": "score", "$why": "why"}
#: A prediction's rows: the factors of why are (kind, proposition, value).
_ANSWER = {"feature": pa.string(), "p": pa.float64(), "why": pa.list_(pa.struct([("kind", pa.string()), ("proposition", pa.string()), ("value", pa.float64())]))}


class QueryError(ValueError):
    """A body that does not make a query."""


@dataclass
class Proposition:
    """Evidence: a category column of the table, and the category that the query states. holds: the column is a condition itself."""

    name: str
    column: Column
    value: str
    holds: bool = False

    def said(self) -> str:
        return self.name if self.holds else f"{self.name} = {self.value}"


class Engine:
    """Queries over registered tables. text_fields: fields matched by their terms, with the analyzer of each ("english", or None for plain words).

    A table is a frame, or a function that reads it, which is asked anew by each
    query. Counts and bins are kept for as long as the files that the table reads
    stay as they are, and only those of a table's last state.
    """

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame | Callable[[], DataFrame]], text_fields: set[str] | dict[str, str | None] | None = None):
        self.spark, self.sources = spark, tables
        self.text_fields = text_fields if isinstance(text_fields, dict) else dict.fromkeys(text_fields or ())
        #: Rows of a count table that the driver takes; None: the library's bound.
        self.bound: int | None = None
        self.tables: dict[str, DataFrame] = {}
        self._seen: dict[str, str] = {}
        self._models: dict[tuple, bayes.Counts | None] = {}
        self._edges: dict[tuple[str, str], list[float]] = {}

    def table(self, body: dict) -> DataFrame:
        """The table as it is now; what was kept of another state of it goes."""
        name = body.get("from")
        if name not in self.sources:
            raise QueryError(f"unknown table {name!r}")
        source = self.sources[name]
        df = source() if callable(source) else source
        now = snapshot_key(df)
        if self._seen.get(name) != now:
            self._models = {k: v for k, v in self._models.items() if k[0] != name}
            self._edges = {k: v for k, v in self._edges.items() if k[0] != name}
            self.tables[name], self._seen[name] = df, now
        return self.tables[name]

    def _field(self, df: DataFrame, field: str) -> Column:
        if field not in df.columns:
            raise QueryError(f"unknown field {field!r}")
        return F.col(field)

    def _literal(self, df: DataFrame, field: str, value: object) -> Column:
        self._field(df, field)
        return F.lit(value).cast(df.schema[field].dataType)

    def condition(self, df: DataFrame, where: object, top: bool = True) -> Column:
        """The condition of a where clause."""
        if not isinstance(where, dict):
            raise QueryError("a condition is an object")
        parts = []
        for field, value in where.items():
            if field in ("$and", "$or"):
                if not isinstance(value, list) or not value:
                    raise QueryError(f"{field} needs a list of conditions")
                parts.append(reduce(Column.__and__ if field == "$and" else Column.__or__, [self.condition(df, v, top and field == "$and") for v in value]))
            elif field == "$not":
                parts.append(~self.condition(df, value, False))
            elif field == "$on":
                if not top:
                    raise QueryError("$on stands at the top or in $and: it restricts the whole population")
                parts.append(self.condition(df, value["prop"]))
            elif isinstance(value, dict):
                parts.append(self._operators(df, field, value))
            elif field in self.text_fields:
                parts.append(self._shares(df, field, value))
            else:
                parts.append(self._field(df, field) == self._literal(df, field, value))
        return reduce(Column.__and__, parts, F.lit(True))

    def _shares(self, df: DataFrame, field: str, value: object) -> Column:
        """Whether the text has one of the stated terms; a null text does not tell."""
        how = self.text_fields[field]
        return has_term(self._field(df, field), stated_terms(value, how), how)

    def _operators(self, df: DataFrame, field: str, ops: dict) -> Column:
        parts = []
        for op, value in ops.items():
            if op == "$or":
                parts.append(reduce(Column.__or__, [self.condition(df, {field: v}, False) for v in value]))
            elif op == "$not":
                parts.append(~self.condition(df, {field: value}, False))
            elif op == "$has" and field in self.text_fields:
                parts.append(self._shares(df, field, value))
            elif op in _COMPARE:
                parts.append(_COMPARE[op](self._field(df, field), self._literal(df, field, value)))
            else:
                raise QueryError(f"unknown operator {op!r}")
        return reduce(Column.__and__, parts, F.lit(True))

    def population(self, df: DataFrame, where: dict) -> DataFrame:
        """df restricted by the `on` part of $on conditions."""
        for on in self._restrictions(where):
            df = df.where(self.condition(df, on))
        return df

    def _restrictions(self, where: dict) -> list[dict]:
        """The `on` parts of a clause, from any depth of $and and of $on's own prop."""
        own = where.get("$on", {})
        out = [own["on"]] if "on" in own else []
        for part in [*([own["prop"]] if own.get("prop") else []), *where.get("$and", [])]:
            out += self._restrictions(part)
        return out

    def _decimal(self, df: DataFrame, field: str) -> bool:
        kind = df.schema[field].dataType.simpleString() if field in df.columns else ""
        return kind in ("double", "float") or kind.startswith("decimal") and not kind.endswith(",0)")

    def binned(self, name: str, field: str, value: Column) -> Column:
        """The decile of a value among the field's: bin 1 to bin 10."""
        if (name, field) not in self._edges:
            [row] = ranking.quantiles(self.tables[name], [], field, [i / 10 for i in range(10)]).collect()
            self._edges[name, field] = row["q"]
        edges = F.array(*[F.lit(e).cast("double") for e in self._edges[name, field]])
        return F.when(value.isNotNull(), F.concat(F.lit("bin "), quantile_bin(value.cast("double"), edges).cast("string")))

    def propositions(self, name: str, where: dict) -> list[Proposition]:
        """The evidence that a where clause states."""
        df, out = self.tables[name], []

        def holds(label: str, condition: Column) -> Proposition:
            return Proposition(label, condition.cast("string"), "true", True)

        for field, value in where.items():
            if field == "$and":
                self.condition(df, {field: value})
                for part in value:
                    out += self.propositions(name, part)
            elif field == "$on":
                out += self.propositions(name, value["prop"])
            elif field in ("$or", "$not"):
                out.append(holds(json.dumps({field: value}, sort_keys=True), self.condition(df, {field: value}, False)))
            elif isinstance(value, dict) and set(value) != {"$has"}:
                out.append(holds(json.dumps({field: value}, sort_keys=True), self._operators(df, field, value)))
            elif field in self.text_fields:
                given = value["$has"] if isinstance(value, dict) else value
                found = terms(self._field(df, field), self.text_fields[field])
                out += [holds(f"{field} has {t}", F.array_contains(found, t)) for t in stated_terms(given, self.text_fields[field])]
            else:
                literal = self._literal(df, field, value["$has"] if isinstance(value, dict) else value)
                column = F.col(field)
                if self._decimal(df, field):
                    column, literal = self.binned(name, field, column), self.binned(name, field, literal)
                [given] = one_row(self.spark).select(category(literal).alias("v")).collect()
                out.append(Proposition(field, category(column), given["v"]))
        names = [p.name for p in out]
        return [p for i, p in enumerate(out) if p.name not in names[:i]]

    def _grouped(self, known: DataFrame, given: list[Proposition]) -> list[Proposition]:
        """Propositions of one cluster of correlated columns as one: that all of them hold."""
        wide = known.select(*[p.column.alias(f"x{i}") for i, p in enumerate(given)])
        out = []
        for cluster in information.cluster_features(wide, wide.columns):
            own = [given[int(c[1:])] for c in cluster]
            all_ = reduce(Column.__and__, [p.column == p.value for p in own])
            out.append(own[0] if len(own) == 1 else Proposition(" and ".join(p.said() for p in own), all_.cast("string"), "true", True))
        return out

    def run(self, kind: str, body: dict) -> DataFrame:
        if kind not in KINDS:
            raise QueryError(f"unknown kind {kind!r}")
        out = getattr(self, kind)(body)
        if "select" in body:
            names = [_SELECT.get(c, c) for c in body["select"]]
            if missing := [c for c in names if c not in out.columns]:
                raise QueryError(f"no result column {missing[0]!r}")
            out = out.select(*names)
        return out.limit(int(body["limit"])) if "limit" in body else out

    def classes(self, df: DataFrame, target: str) -> list[str]:
        """The target's values in name order, at most 1,000."""
        found = [r[0] for r in df.where(F.col(target).isNotNull()).select(F.col(target).cast("string")).distinct().limit(1001).collect()]
        if len(found) > 1000:
            raise QueryError(f"{target} has over 1,000 values")
        return sorted(found)

    def predict(self, body: dict) -> DataFrame:
        """(feature, p, why), likeliest first: the target's value given the conditions of where.

        why, where it is selected, are the factors whose product is p: baseP, the
        lift of each proposition, those that tell most first, and the normaliser.
        """
        name, target, where = body.get("from"), body["predict"], body.get("where", {})
        df = self.population(self.table(body), where)
        self._field(df, target)
        known = df.where(F.col(target).isNotNull()).withColumn("cls", F.col(target).cast("string"))
        given = self.propositions(name, where)
        if body.get("config", {}).get("ai") == "high" and len(given) > 1:
            given = self._grouped(known, given)
        scope = json.dumps(self._restrictions(where), sort_keys=True)
        asked = (name, target, scope, *[p.name for p in given])
        columns = [p.column.alias(f"x{i}") for i, p in enumerate(given)]
        if asked not in self._models:
            self._models[asked] = bayes.fit(known.select("cls", *columns), [f"x{i}" for i in range(len(given))], None, bound=self.bound)
        model = self._models[asked]
        if model is None:  # a count table too large for the driver: only what the stated values need
            model = bayes.fit_stated(known.select("cls", *columns), {f"x{i}": p.value for i, p in enumerate(given)}, self.classes(df, target))
        rows = sorted(_predicted(model, given), key=lambda r: (-r[1], r[0]))
        return local_rows(self.spark, rows, _ANSWER).drop(*([] if "$why" in body.get("select", []) else ["why"]))

    def classify(self, name: str, text: str, target: str, least: int = 40) -> DataFrame:
        """(feature, p) of the target for a text: its keyword signals that say something are the given fields."""
        if len(text) < least:
            raise QueryError(f"a text has at least {least} characters")
        fields = [c for c in keyword_signals(F.lit("")) if c in self.table({"from": name}).columns]
        signals = one_row(self.spark).select(*[keyword_signals(F.lit(text))[c].alias(c) for c in fields]).first().asDict()
        where = {k: v for k, v in signals.items() if v not in ("not_stated", "none")}
        return self.predict({"from": name, "where": where, "predict": target})

    def relate(self, body: dict) -> DataFrame:
        """(field, value, n, lift) of the fields' values toward the condition, greatest lift first.

        The base rate is the whole population's; only $on restricts that.
        """
        df, where = self.table(body), body.get("where", {})
        holds = F.coalesce(self.condition(df, where), F.lit(False))
        df = self.population(df, where).withColumn("_holds", holds)
        fields = list(body["relate"])
        for f in fields:
            self._field(df, f)
        df = df.withColumns({f: self.binned(body["from"], f, F.col(f)) for f in fields if self._decimal(df, f)})
        found = lift.lift_table(df, fields, F.col("_holds"), int(body.get("support", 1)))
        return found.orderBy(F.desc(F.round("lift", 9)), "field", "value")

    def match(self, body: dict) -> DataFrame:
        """(feature, score): the field's values, each scored by its naive-Bayes probability given where."""
        return self.predict({**body, "predict": body["match"]}).withColumnRenamed("p", "score")

    def similarity(self, body: dict) -> DataFrame:
        """Rows that share most with the given values: `key` names the table's id."""
        df, key, name = self.table(body), body["key"], body["from"]
        score = self._relevance(name, {f: {"$has": v} for f, v in body["similarity"].items()})
        return df.select(F.col(key), score.alias("score")).where("score > 0").orderBy(F.desc(F.round("score", 9)), key)

    def _relevance(self, name: str, where: dict) -> Column:
        """The sum of ln(N / its rows) over the propositions that a row satisfies."""
        given, df = self.propositions(name, where), self.tables[name]
        counts = df.agg(F.count("*").alias("n"), *[F.count(F.when(p.column == p.value, 1)).alias(f"c{i}") for i, p in enumerate(given)]).first()
        weights = [math.log(counts["n"] / counts[f"c{i}"]) if counts[f"c{i}"] else 0.0 for i in range(len(given))]
        return sum((F.when(p.column == p.value, F.lit(w)).otherwise(0.0) for p, w in zip(given, weights)), F.lit(0.0))

    def _bm25(self, df: DataFrame, where: dict, k1: float = 1.2, b: float = 0.75) -> Column:
        """The sum of the BM25 scores of the top-level text conditions; statistics are those of all rows whose text is known."""
        score = F.lit(0.0)
        for field, value in where.items():
            if field not in self.text_fields:
                continue
            wanted = stated_terms(value["$has"] if isinstance(value, dict) and set(value) == {"$has"} else value, self.text_fields[field])
            if not wanted:
                continue
            found = term_counts(F.col(field), wanted, self.text_fields[field])
            has = [F.count(F.when(F.col("_t.counts")[i] > 0, 1)).alias(f"d{i}") for i in range(len(wanted))]
            known = df.where(F.col(field).isNotNull()).select(found.alias("_t"))
            facts = known.agg(F.count("*").alias("n"), F.avg("_t.size").alias("mean"), *has).first()  # one row
            rare = [math.log(1 + (facts["n"] - facts[f"d{i}"] + 0.5) / (facts[f"d{i}"] + 0.5)) for i in range(len(wanted))]
            weight = F.array(*[F.lit(x) for x in rare])

            def scored(t: Column) -> Column:
                norm = k1 * (1 - b + b * t["size"] / F.lit(facts["mean"] or 1.0))  # noqa: B023
                return F.aggregate(F.zip_with(t["counts"], weight, lambda n, w: w * n * (k1 + 1) / (n + norm)), F.lit(0.0), lambda x, y: x + y)  # noqa: B023

            score = score + F.coalesce(F.transform(F.array(found), scored)[0], F.lit(0.0))  # the text is analysed once a row
        return score

    def search(self, body: dict) -> DataFrame:
        """Rows under where, by orderBy: a field, {field: "desc"}, {"field": f, "desc": true}, "$similarity", "$bm25", or a list of those.

        $bm25 ranks by the text conditions of where: how often a text has the stated
        terms, its length, and how few texts have them. $similarity sums ln(N / its
        rows) over the propositions that a row satisfies.
        """
        df, where = self.table(body), body.get("where", {})
        out, keys, order = df.where(self.condition(df, where)), [], body.get("orderBy") or []
        for f in [order] if isinstance(order, (str, dict)) else order:
            if f == "$similarity":
                out = out.withColumn("score", self._relevance(body["from"], where))
                keys.append(F.desc(F.round("score", 9)))
            elif f == "$bm25":
                out = out.withColumn("score", self._bm25(df, where))
                keys.append(F.desc(F.round("score", 9)))
            elif isinstance(f, dict) and "field" in f:
                keys.append(F.desc(f["field"]) if f.get("desc") else F.asc(f["field"]))
            else:
                keys += [F.asc(f)] if isinstance(f, str) else [F.desc(k) if v == "desc" else F.asc(k) for k, v in f.items()]
        keys += [F.asc(c) for c in body.get("ties", [])]
        return out.orderBy(*keys) if keys else out

    def evaluate(self, body: dict) -> DataFrame:
        """One row of metrics: trained where the test condition does not hold, tested where it does."""
        query = body["evaluate"]
        df, target = self.table(query), query["predict"]
        fields = {f: v["$get"] if isinstance(v, dict) and "$get" in v else f for f, v in query.get("where", {}).items()}
        columns = {f: self.binned(query["from"], g, F.col(g)) if self._decimal(df, g) else self._field(df, g) for f, g in fields.items()}
        known = df.where(F.col(target).isNotNull()).withColumn("cls", F.col(target).cast("string"))
        test = F.coalesce(self.condition(df, body["test"]), F.lit(False))
        classes = self.classes(df, target)
        named = [c.alias(f) for f, c in columns.items()]
        rows = known.where(test).select(F.monotonically_increasing_id().alias("id"), "cls", *named)
        return bayes.evaluate(bayes.predict(known.where(~test).select("cls", *named), rows, list(fields), classes), classes)


def _predicted(model: bayes.Counts, given: list[Proposition]) -> list[tuple]:
    """(class, p, factors) of what the propositions state; without any, the classes' shares."""
    if not given:
        n = sum(model.sizes[None])
        return [(c, m / n, [("baseP", None, m / n)]) for c, m in zip(model.classes, model.sizes[None])]
    prior, n = model.prior(None), sum(model.sizes[None])
    parts = [model.likelihoods(None, f"x{i}", p.value) for i, p in enumerate(given)]
    sums = [q + sum(x[c] for x in parts) for c, q in enumerate(prior)]
    top = max(sums, default=0.0)
    whole = sum(math.exp(s - top) for s in sums)
    out = []
    shares = []
    for i, p in enumerate(given):
        seen = sum(model.values.get((None, f"x{i}", p.value), [0]))
        shares.append(math.log(seen / n) if seen else math.log(model.alpha / (n + model.alpha * (model.seen[None, f"x{i}"] + 1))))
    for c, name in enumerate(model.classes):
        lifts = sorted(((p.name, p.said(), x[c] - s) for p, x, s in zip(given, parts, shares)), key=lambda y: (-round(abs(y[2]), 9), y[0]))
        factors = [("baseP", None, math.exp(prior[c]))]
        factors += [("relatedPropositionLift", said, math.exp(x)) for _, said, x in lifts]
        factors.append(("normalizer", None, math.exp(sum(shares) - top) / whole))
        out.append((name, math.exp(sums[c] - top) / whole, factors))
    return out


def predicted(spark: SparkSession, model: bayes.Counts, stated: dict[str, str]) -> DataFrame:
    """(feature, p) of stated values under a model's counts."""
    renamed = bayes.Counts.__new__(bayes.Counts)
    renamed.__dict__.update(model.__dict__)
    places = {f: f"x{i}" for i, f in enumerate(stated)}
    renamed.values = {(k, places.get(f, f), v): n for (k, f, v), n in model.values.items()}
    renamed.seen = {(k, places.get(f, f)): n for (k, f), n in model.seen.items()}
    given = [Proposition(f, F.lit(v), v) for f, v in stated.items()]
    return local_rows(spark, _predicted(renamed, given), _ANSWER).select("feature", "p")


class Gateway:
    """The checked way in for others' bodies: one table, four kinds, and a status with each answer."""

    def __init__(self, engine: Engine, table: str = "companies", kinds: tuple[str, ...] = KINDS[:4]):
        self.engine, self.name, self.kinds = engine, table, kinds

    def post(self, kind: str, body: object) -> tuple[int, DataFrame | str]:
        """(200, rows), (400, why the kind or table is refused) or (422, why the body makes no query)."""
        if kind not in self.kinds:
            return 400, f"kind {kind!r} is not served"
        if not isinstance(body, dict) or body.get("from") != self.name:
            return 400, f"only table {self.name!r} is served"
        try:
            return 200, self.engine.run(kind, body)
        except (QueryError, KeyError, TypeError) as e:
            return 422, str(e)


def response(hits: DataFrame, value: str, p: str, classes: list[str]) -> DataFrame:
    """Hits in fixed class order, 0 where a class is missing."""
    grid = one_row(hits.sparkSession).select(F.posexplode(F.array(*[F.lit(c) for c in classes])).alias("place", "feature"))
    return grid.join(hits.select(F.col(value).alias("feature"), F.col(p).alias("p")), "feature", "left").select("place", "feature", F.coalesce("p", F.lit(0.0)).alias("p"))
