"""Kept counts, scopes, explanations, analyzers and ranked search; quantiles and ranks under ties."""

import math
import random

import pytest
from pyspark.sql import functions as F

from presage.functions.analysis import stated_terms, terms
from presage.operators import bayes, ranking
from presage.operators.count_store import PARTS, CountStore, fitted
from presage.plans.facade import Engine

KIND = "id int, f string, b boolean, status string, note string, cls string"


def some_rows(seed, n, first=0):
    rng = random.Random(seed)
    return [(first + i, rng.choice("abc"), rng.random() < 0.5, rng.choice("FO"), rng.choice(["Large, Japan", "small-cap", None]), rng.choice("xyz")) for i in range(n)]


def answers(df):
    return {r["feature"]: round(r["p"], 9) for r in df.collect()}


def test_a_replaced_table_answers_for_itself(spark, tmp_path):
    path = str(tmp_path / "t")
    body = {"from": "t", "where": {"f": "a"}, "predict": "cls"}
    engine = Engine(spark, {"t": lambda: spark.read.parquet(path)})
    for seed in (1, 2):
        spark.createDataFrame(some_rows(seed, 80), KIND).write.mode("overwrite").parquet(path)
        fresh = Engine(spark, {"t": spark.read.parquet(path)})
        assert answers(engine.run("predict", body)) == answers(fresh.run("predict", body))
        assert len(engine._models) == 1
    kept = engine._models
    engine.run("predict", body)
    assert engine._models is kept  # nothing changed, nothing counted


def test_nested_scopes_do_not_share_counts(spark):
    df = spark.createDataFrame(some_rows(3, 90), KIND)
    engine = Engine(spark, {"t": df})
    for status in "FO":
        on = {"$on": {"prop": {"f": "a"}, "on": {"status": status}}}
        got = answers(engine.run("predict", {"from": "t", "where": {"$and": [{"$and": [on]}]}, "predict": "cls"}))
        alone = Engine(spark, {"t": df.where(F.col("status") == status)})
        assert got == answers(alone.run("predict", {"from": "t", "where": {"f": "a"}, "predict": "cls"}))


def test_why_names_booleans_and_works_beyond_the_bound(spark):
    df = spark.createDataFrame(some_rows(4, 60), KIND)
    body = {"from": "t", "where": {"b": True, "f": "a", "$not": {"status": "F"}}, "predict": "cls", "select": ["feature", "$p", "$why"]}
    small, large = Engine(spark, {"t": df}), Engine(spark, {"t": df})
    large.bound = 2
    told = [{(r["feature"], w["kind"], w["proposition"], round(w["value"], 9)) for r in e.run("predict", body).collect() for w in r["why"]} for e in (small, large)]
    assert told[0] == told[1]
    assert {x[2] for x in told[0]} == {None, "b = true", "f = a", '{"$not": {"status": "F"}}'}
    for r in large.run("predict", body).collect():
        assert math.prod(w["value"] for w in r["why"]) == pytest.approx(r["p"])


def test_residuals_beyond_the_bound(spark):
    rng = random.Random(5)
    rows = [(i, i % 3, rng.choice("xy"), rng.choice(["L0", "L1"]), rng.choice("abc"), rng.choice([None, "q"])) for i in range(150)]
    df = spark.createDataFrame(rows, "id int, fold int, cls string, t string, f string, g string")
    run = lambda bound: {r["id"]: [round(x, 9) for x in r["p"]] for r in bayes.cross_validate_clustered(df, {"t": ["f", "g"]}, ["x", "y"], [0, 1, 2], beta=0.5, bound=bound).collect()}
    assert run(None) == run(3) and len(run(3)) == 150


def test_counts_follow_a_growing_table(spark, tmp_path):
    path, store = str(tmp_path / "t"), CountStore(spark, str(tmp_path / "counts"))
    view = lambda df: df.select(F.lit(None).cast("int").alias("fold"), "cls", "f", "note")
    flat = lambda df: sorted(map(repr, ((*r,) for r in df.select("fold", "cls", "field", "value", "n").collect())))

    def same():
        whole = bayes.counted(view(spark.read.parquet(path)), ["f", "note"])
        assert flat(store.counts("m", path, view, ["f", "note"])) == flat(whole)
        return store.did

    for i in range(PARTS + 3):
        spark.createDataFrame(some_rows(i, 7, 100 * i), KIND).coalesce(1).write.mode("append").parquet(path)
        if i % 6:
            store.counts("m", path, view, ["f", "note"])
        else:
            assert same() == ("all" if i == 0 else "new")
    assert same() == "none"
    spark.createDataFrame(some_rows(99, 20), KIND).write.mode("overwrite").parquet(path)
    assert same() == "all"
    model = fitted(store.counts("m", path, view, ["f", "note"]), ["f", "note"])
    assert sum(model.sizes[None]) == 20


def test_counts_of_a_stream(spark, tmp_path):
    """Each batch adds its counts once, also when it comes again, and also after parts were added up."""
    store = CountStore(spark, str(tmp_path / "counts"))
    source, view = str(tmp_path / "in"), lambda df: df.select(F.lit(None).cast("int").alias("fold"), "cls", "f")
    for i in range(PARTS + 2):
        spark.createDataFrame(some_rows(i, 5), KIND).coalesce(1).write.mode("append").parquet(source)
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = stream.writeStream.foreachBatch(lambda df, i: store.add_batch("m", view(df), i, ["f"])).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    store.add_batch("m", view(spark.createDataFrame(some_rows(0, 5), KIND)), 0, ["f"])
    whole = bayes.counted(view(spark.read.parquet(source)), ["f"])
    got = {tuple(r)[:4]: r["n"] for r in store.stream_counts("m").select("fold", "cls", "field", "value", "n").collect()}
    assert got == {tuple(r)[:4]: r["n"] for r in whole.collect()}


def test_stated_and_text_terms_are_alike(spark):
    texts = ["Large-cap, Japan; the pricing of stories", "running and stopped, quickly!", "Äpfel 12 3rd l'été", "", "glasses classes buses boxes ties"]
    for how in (None, "english"):
        df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", terms("t", how).alias("x"))
        for r in df.collect():
            assert list(dict.fromkeys(r["x"])) == stated_terms(r["t"], how)
    assert stated_terms("Pricing the prices, priced", "english") == ["pric"]
    e = Engine(spark, {"t": spark.createDataFrame(some_rows(7, 40), KIND)}, {"note"})
    n = e.run("search", {"from": "t", "where": {"note": "Large, Japan"}}).count()
    assert n > 0
    for where in ({"note": {"$has": "large"}}, {"note": "large-thing"}, {"note": "LARGE"}):
        assert e.run("search", {"from": "t", "where": where}).count() == n
        assert e.run("relate", {"from": "t", "where": where, "relate": ["f"]}).count() > 0
        assert e.run("predict", {"from": "t", "where": where, "predict": "cls"}).count() == 3


def test_ranked_search_against_brute_force(spark):
    rng = random.Random(8)
    vocabulary = ["price", "pricing", "story", "stories", "the", "and", "cat", "cats", "run", "running", "x"]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 30))) if i % 9 else None) for i in range(80)]
    df = spark.createDataFrame(rows, "id int, t string")
    asked = "the prices of a cat, running"
    for how in ("english", None):
        wanted = stated_terms(asked, how)
        texts = {i: [w for x in t.split() for w in stated_terms(x, how)] for i, t in rows if t is not None}
        mean = sum(map(len, texts.values())) / len(texts)
        score = {}
        for i, found in texts.items():
            for w in wanted:
                n = sum(w in x for x in texts.values())
                f = found.count(w)
                score[i] = score.get(i, 0) + math.log(1 + (len(texts) - n + 0.5) / (n + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(found) / mean))
        want = sorted(((-round(s, 9), i) for i, s in score.items() if set(texts[i]) & set(wanted)))
        e = Engine(spark, {"t": df}, {"t": how})
        got = e.run("search", {"from": "t", "where": {"t": asked}, "orderBy": "$bm25", "ties": ["id"]}).collect()
        assert [r["id"] for r in got] == [i for _, i in want]
        assert [r["score"] for r in got] == pytest.approx([-s for s, _ in want], abs=1e-8)
    assert Engine(spark, {"t": df}, {"t": "english"}).run("search", {"from": "t", "where": {"t": "the and"}, "orderBy": "$bm25"}).count() == 0


@pytest.mark.parametrize("limit", [10**6, 0])
def test_quantiles_of_ties(spark, limit):
    import numpy as np

    rng = np.random.default_rng(9)
    rows = [(k, float(x)) for k, n in (("a", 400), (None, 30), ("b", 1)) for x in np.where(rng.random(n) < 0.7, 3.0, rng.normal(size=n))]
    df = spark.createDataFrame(rows, "k string, x double")
    asked = [0.0, 0.1, 0.33, 0.5, 0.99, 1.0]
    got = {r["k"]: r["q"] for r in ranking.quantiles(df, ["k"], "x", asked, limit=limit).collect()}
    for k in ("a", "b", None):
        assert np.allclose(got[k], np.quantile([x for g, x in rows if g == k], asked))
    constant = df.select(F.lit(7).alias("x"))
    assert ranking.quantiles(constant, [], "x", [0.1, 0.9], limit=limit).first()["q"] == [7.0, 7.0]


def test_a_constant_column_is_spread(spark):
    """Rows of one value go to all tasks, and places are still those of one order."""
    df = spark.range(20_000).select("id", F.lit(1).alias("c"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        dealt = df.repartitionByRange(8, "c", F.xxhash64(*df.columns)).groupBy(F.spark_partition_id()).count().collect()
        assert len(dealt) == 8 and max(r["count"] for r in dealt) < 2 * 20_000 / 8
        placed = ranking.grouped_rank(df, [], [F.col("c")], "r", "n")
        assert placed.select("r").distinct().count() == 20_000 and placed.agg(F.min("r"), F.max("r"), F.max("n")).first() == (1, 20_000, 20_000)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
