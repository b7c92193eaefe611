"""Hand-computed cases of what SQL does not check: edges, ties, order, invariants."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from presage.functions import buckets, finance, text
from presage.operators import bayes, events, grading, information, joins, lift, ranking
from presage.plans.facade import Engine, QueryError
from presage.sources import readers, sinks
from presage.streaming import windows

EDGES = {
    "outcome": [(-0.1000001, "disaster"), (-0.10, "poor"), (0.0, "market"), (0.07, "good"), (0.13, "great"), (None, None)],
    "momentum": [(30.0, "strong"), (29.9, "neutral"), (-10.0, "weak"), (-9.9, "neutral")],
    "volatility": [(40.0, "high"), (22.0, "low"), (22.1, "medium")],
    "pe": [(-0.1, "negative_earnings"), (0.0, "cheap"), (15.0, "fair"), (30.0, "fair"), (30.1, "expensive")],
    "growth": [(0.15, "high"), (0.0, "shrinking"), (0.1, "moderate")],
    "leverage": [(-1.0, "negative_equity"), (0.0, "low"), (0.5, "moderate"), (1.5, "moderate"), (1.6, "high")],
    "roe": [(-0.1, "negative"), (0.2, "high"), (0.1, "solid"), (0.05, "low")],
    "return_20d": [(-10.0, "sharp_down"), (-3.0, "down"), (0.0, "flat"), (3.0, "up"), (10.0, "sharp_up")],
    "reaction_3": [(-3.0, "down"), (2.9, "flat"), (3.0, "up")],
    "reaction_1d": [(-2.0, "down"), (1.9, "flat"), (2.0, "up")],
    "confidence": [(0.5, "HIGH"), (0.3, "MEDIUM"), (0.29, "LOW")],
}


@pytest.mark.parametrize("name", sorted(EDGES))
def test_bucket_edges(spark, name):
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(EDGES[name])], "i int, x double")
    got = [r["b"] for r in df.select("i", buckets.bucket(name, F.col("x")).alias("b")).orderBy("i").collect()]
    assert got == [b for _, b in EDGES[name]]


def test_verdict_gates(spark):
    rows = [(4.0, 1.0, 40, 40, "fundamentals"), (1.5, 1.0, 40, 40, "sentiment"), (2.0, 1.0, 40, 40, "mixed"), (4.0, 1.0, 39, 40, None), (4.0, 0.0, 40, 40, None)]
    df = spark.createDataFrame(rows, "g double, d double, u int, n int, want string")
    for r in df.select("want", buckets.verdict(F.col("g"), F.col("d"), F.col("u"), F.col("n")).alias("got")).collect():
        assert r["got"] == r["want"]


def test_equal_count_bins_put_the_rest_last(spark):
    for n, want in ((13, [1] * 9 + [4]), (7, [1] * 7)):
        df = spark.createDataFrame([(i, float(i), 0) for i in range(n)], "id int, p double, hit int")
        got = ranking.calibration(df, "p", "hit", "id").orderBy("bin").collect()
        assert [r["n"] for r in got] == want


def test_folds(spark):
    want = {"NVDA": "4", "COST": "0", "BRK.B": "3", "AAPL": "0", "WIN": "1", "X": "4"}
    df = spark.createDataFrame([(k,) for k in want], "t string")
    assert {r["t"]: r["f"] for r in df.select("t", text.fold_of(F.col("t")).alias("f")).collect()} == want


def test_themes_and_titles(spark):
    rows = [("9.01,2.02", "earnings"), ("5.03", "exhibits only"), ("9.99", "other"), ("5.02,2.02", "management change"), ("", "exhibits only")]
    df = spark.createDataFrame(rows, "i string, want string")
    assert all(r["want"] == r["got"] for r in df.select("want", text.theme(F.col("i")).alias("got")).collect())
    names = spark.createDataFrame([("BANK OF THE OZARKS INC", "Bank of the Ozarks Inc"), ("AbbVie", "AbbVie")], "n string, want string")
    assert all(r["want"] == r["got"] for r in names.select("want", text.smart_title(F.col("n")).alias("got")).collect())


def test_range_labels(spark):
    df = spark.range(1).select(*[c.alias(k) for k, c in finance.range_labels(F.lit(1.0)).items()])
    assert df.first().asDict() == {"disaster": "< -10%", "poor": "-10% to +0%", "market": "+0% to +7%", "good": "+7% to +13%", "great": ">= +13%"}


def test_asof_excludes_the_cutoff_and_breaks_ties(spark):
    d = dt.date
    left = spark.createDataFrame([("a", d(2020, 1, 1)), ("b", d(2020, 1, 1)), ("c", d(2020, 1, 1))], "k string, cut date")
    right = spark.createDataFrame([("a", d(2020, 1, 1), 1, 1), ("a", d(2019, 1, 1), 2, 1), ("a", d(2019, 1, 1), 3, 2), ("b", d(2021, 1, 1), 4, 1)], "k string, ts date, v int, tie int")
    got = {r["k"]: r["v"] for r in joins.asof_backward(left, right, "k", "cut", "ts", "v", "tie").collect()}
    assert got == {"a": 3, "b": None, "c": None}
    got = {r["k"]: r["v"] for r in joins.asof_backward(left, right, "k", "cut", "ts", "v", "tie", strict=False).collect()}
    assert got["a"] == 1


def test_membership(spark):
    d = dt.date
    today = spark.createDataFrame([("A",), ("B",)], "ticker string")
    changes = spark.createDataFrame([("A", d(2021, 5, 1), "add"), ("C", d(2021, 5, 1), "remove"), ("C", d(2018, 5, 1), "add"), ("D", d(2018, 5, 1), "remove")], "ticker string, when date, op string")
    got = joins.members_at(today, changes, [d(2017, 1, 1), d(2019, 1, 1)]).collect()
    by = {c: sorted(r["ticker"] for r in got if r["cutoff"] == c) for c in (d(2017, 1, 1), d(2019, 1, 1))}
    assert by == {d(2017, 1, 1): ["B", "D"], d(2019, 1, 1): ["B", "C"]}


def test_overlay(spark):
    base = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 2.0)], "t string, v int, x double")
    patch = spark.createDataFrame([("a", 1, 9.0), ("z", 1, 5.0)], "t string, v int, x double")
    assert {r["t"]: r["x"] for r in joins.overlay(base, patch, ["t", "v"], ["x"]).collect()} == {"a": 9.0, "b": 2.0}


def test_naive_bayes_by_hand(spark):
    import math

    train = spark.createDataFrame([("a", "x", "p"), ("a", "y", "p"), ("b", "x", "q"), ("b", "y", "q"), ("b", "y", "q"), ("a", "y", "q")], "cls string, f string, g string")
    test = spark.createDataFrame([(1, "a", "x", "new")], "id int, cls string, f string, g string")
    classes = ["a", "b", "c", "d", "e"]
    p = bayes.predict(train, test, ["f", "g"], classes).first()["p"]
    n = {"a": 3, "b": 3}
    x = {"a": 1, "b": 1}
    s = [math.log((n.get(c, 0) + 1) / 11) + math.log((x.get(c, 0) + 1) / (n.get(c, 0) + 3)) + math.log(1 / (n.get(c, 0) + 3)) for c in classes]
    e = [math.exp(v) for v in s]
    assert p == pytest.approx([v / sum(e) for v in e])
    assert sum(p) == pytest.approx(1)


def test_cross_validation_equals_a_model_a_fold(spark):
    rows = [(i, i % 3, "ab"[i * 7 % 5 > 2], "xyz"[i * i % 3], None if i % 4 == 0 else "pq"[i % 2]) for i in range(40)]
    base = spark.createDataFrame(rows, "id int, fold int, cls string, f string, g string")
    got = {r["id"]: r["p"] for r in bayes.cross_validate(base, ["f", "g"], ["a", "b"], [0, 1, 2]).collect()}
    assert len(got) == 40
    for k in range(3):
        one = bayes.predict(base.where(F.col("fold") != k), base.where(F.col("fold") == k), ["f", "g"], ["a", "b"])
        for r in one.collect():
            assert got[r["id"]] == pytest.approx(r["p"])


def test_mutual_information(spark):
    rows = [("a", "a", "x", "k"), ("a", "a", "y", "k"), ("b", "b", "x", "k"), ("b", "b", "y", "k")]
    df = spark.createDataFrame(rows, "p string, q string, r string, c string")
    got = {(r["fa"], r["fb"]): r["nmi"] for r in information.mutual_information(df, ["p", "q", "r", "c"]).collect()}
    assert got["p", "q"] == pytest.approx(1)
    assert got["p", "r"] == pytest.approx(0, abs=1e-12)
    assert got["p", "c"] == 0


def test_clusters(spark):
    rows = [("ab"[i % 2], "ab"[i % 2], "xyz"[i % 3], "xyz"[i % 3], "k") for i in range(60)]
    df = spark.createDataFrame(rows, "p string, q string, r string, s string, c string")
    assert information.cluster_features(df, ["p", "q", "r", "s", "c"]) == [["p", "q"], ["r", "s"], ["c"]]


def test_reactions_need_rows_and_an_anchor(spark):
    t = lambda i: dt.datetime(2020, 1, 1) + dt.timedelta(days=i)
    prices = spark.createDataFrame([(1, t(i), 100.0 + i) for i in range(7)] + [(2, t(0), 0.0), (2, t(1), 5.0)], "k int, ts timestamp, close double")
    asked = spark.createDataFrame([(1, t(0), "none before"), (1, t(1), "six"), (2, t(1), "zero anchor")], "k int, at timestamp, name string")
    got = {r["name"]: r for r in events.reactions(prices, asked, "k", "ts", "close", "at", (1, 5, 20)).collect()}
    assert set(got) == {"six"}
    assert got["six"]["r_1"] == pytest.approx(2.0)
    assert got["six"]["r_5"] == pytest.approx(6.0)
    assert got["six"]["r_20"] is None


def test_quantile_edges(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "x double")
    edges = df.agg(F.percentile("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("e")).first()["e"]
    assert edges == [1.75, 2.5, 4.75]
    assert spark.range(1).select(buckets.level(F.lit(2.5), F.array(*[F.lit(e) for e in edges])).alias("l")).first()["l"] == "L2"


def test_where_language(spark):
    df = spark.createDataFrame([(1, "a", 5.0, "Red car"), (2, "b", 7.0, "blue sky"), (3, None, 9.0, None)], "id int, f string, x double, note string")
    e = Engine(spark, {"t": df}, {"note"})
    ids = lambda w: sorted(r["id"] for r in df.where(e.condition(df, w)).collect())
    assert ids({"f": "a"}) == [1]
    assert ids({"x": {"$gte": 5, "$lt": 9}}) == [1, 2]
    assert ids({"$or": [{"f": "a"}, {"x": {"$gt": 8}}]}) == [1, 3]
    assert ids({"$not": {"f": "a"}}) == [2]
    assert ids({"$and": [{"f": {"$has": "b"}}, {"x": 7}]}) == [2]
    assert ids({"note": "RED wine"}) == [1]
    assert ids({"$on": {"prop": {"f": "a"}, "on": {"x": 5}}}) == [1]
    for bad in ({"nope": 1}, {"x": {"$like": 1}}, {"$or": []}):
        with pytest.raises(QueryError):
            e.condition(df, bad)
    with pytest.raises(QueryError):
        e.run("drop", {"from": "t"})
    with pytest.raises(QueryError):
        e.run("search", {"from": "u"})


def test_evaluate_masks_the_test_rows(spark):
    rows = [(i, "ab"[i % 2], "xy"[i % 2], i % 5) for i in range(50)]
    df = spark.createDataFrame(rows, "id int, cls string, f string, fold int")
    m = Engine(spark, {"t": df}).run("evaluate", {"test": {"fold": 0}, "evaluate": {"from": "t", "where": {"f": {"$get": "f"}}, "predict": "cls"}}).first()
    assert m["n"] == 10 and m["accuracy"] == 1 and m["info_gain"] > 0.5


def test_similar_leaves_out_self_before_taking_k(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], "x", None if i == 2 else "o") for i in range(8)], "id int, f string, g string, o string")
    got = ranking.similar(df, df.where("id = 0"), "id", ["f", "g"], 2, "o").orderBy("rank").collect()
    assert [r["id"] for r in got] == [4, 6]


def test_csv_comments_and_missing(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,x\n# a note\na,1.5\nb,\nc,nan\n")
    got = {r["k"]: r["x"] for r in readers.csv(spark, f"file://{tmp_path}/a.csv", "k string, x double", "#").collect()}
    assert got == {"a": 1.5, "b": None, "c": None}


def test_append_new_and_refresh(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    sinks.refresh(a, path)
    sinks.append_new(spark.createDataFrame([(2, "z"), (3, "w")], "k int, v string"), path, ["k"])
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(path).collect()) == [(1, "x"), (2, "y"), (3, "w")]
    sinks.write_json(spark.createDataFrame([(1, 0.123456)], "k int, x double"), f"file://{tmp_path}/j")
    assert spark.read.json(f"file://{tmp_path}/j").first()["x"] == 0.1235
    marked = sinks.pending(spark, "a int", ["labels"]).first()
    assert marked["a"] is None and marked["_pending"] and marked["_missing"] == "labels"


def test_html_tables(spark):
    page = "<table><tr><th>T</th><th>N</th></tr><tr><td>AAPL</td><td><b>Apple</b></td></tr></table>"
    rows = readers.html_tables(spark.createDataFrame([(1, page)], "page_id int, html string")).orderBy("row").collect()
    assert [r["cells"] for r in rows] == [["T", "N"], ["AAPL", "Apple"]]


def test_sections(spark):
    long = "x" * 60_000 + "\n Management's Discussion and Analysis of things" + "y" * 40_000
    proxy = "Compensation Discussion and Analysis " + "a" * 5_000 + " compensation discussion  and analysis " + "b" * 3_000
    df = spark.createDataFrame([(1, long), (2, "short"), (3, proxy)], "i int, t string")
    got = {r["i"]: r for r in df.select("i", *[c.alias(k) for k, c in text.annual_sections(F.col("t")).items()]).collect()}
    assert len(got[1]["business_and_risks"]) == 42_000 and got[1]["mda"].lstrip().startswith("Management") and got[1]["head"] is None
    assert got[2]["head"] == "short"
    got = {r["i"]: r for r in df.select("i", *[c.alias(k) for k, c in text.proxy_sections(F.col("t")).items()]).collect()}
    assert got[3]["cd_a"].startswith("compensation discussion  and") and got[3]["biographies"] is None


def test_streaming_matches_batch(spark, tmp_path):
    t = lambda m: dt.datetime(2020, 1, 1, 0, m)
    rows = spark.createDataFrame([("a", t(1)), ("a", t(2)), ("b", t(20)), ("a", t(40))], "k string, ts timestamp")
    rows.write.parquet(f"file://{tmp_path}/in")
    stream = windows.tumbling(spark.readStream.schema(rows.schema).parquet(f"file://{tmp_path}/in"), "ts", ["k"], "10 minutes", "0 seconds")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("tumbled").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = sorted(map(tuple, spark.table("tumbled").collect()))
    assert got == sorted(map(tuple, windows.tumbling(rows, "ts", ["k"], "10 minutes").collect()))


def test_lift_of_an_empty_table(spark):
    df = spark.createDataFrame([], "f string, y boolean")
    assert lift.lift_table(df, ["f"], F.col("y")).count() == 0


def test_classify_and_grading(spark):
    docs = spark.createDataFrame([("record growth beat expectations this quarter, raise outlook", "up"), ("we miss and lower guidance after a decline in orders", "down")] * 5, "text string, bucket string")
    e = Engine(spark, {"t": grading.by_keywords(docs, "text")})
    hit = e.classify("t", "a strong quarter with record revenue, we raise guidance again", "bucket").first()
    assert hit["feature"] == "up" and hit["p"] > 0.5
    with pytest.raises(QueryError):
        e.classify("t", "too short", "bucket")
    out = grading.graded(docs, lambda b: b.assign(n=b["text"].str.len())[["bucket", "n"]], "bucket string, n bigint")
    assert out.count() == 10
    runs = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y"), ("a", 2, "y"), ("b", 0, "q"), ("b", 1, "p")], "k string, run int, g string")
    assert {r["k"]: r["g"] for r in grading.modal(runs, ["k"], "g", "run").collect()} == {"a": "y", "b": "q"}


def test_combined_excerpt_keeps_its_budget(spark):
    df = spark.createDataFrame([("a" * 5_000, "b" * 5_000)], "x string, y string")
    got = df.select(text.combined_excerpt({"head": F.col("x")}, {"head": F.col("y")}, 400).alias("t")).first()["t"]
    assert got.count("a" * 100) == 12 and got.count("b") == 400


def test_read_through(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for _ in range(2):
        assert readers.read_through(spark, f"file://{tmp_path}/c", make).count() == 3
    assert made == [1]


def test_asof_by_keeps_rows_with_nulls_and_repeats(spark):
    d = lambda x: dt.date(2020, 1, x)
    left = spark.createDataFrame([("A", d(9), None), ("A", d(9), None), ("B", d(9), "x"), (None, d(9), "y"), ("A", None, "z")], "k string, c date, note string")
    right = spark.createDataFrame([("A", d(1), d(1), 1.0), ("A", d(2), d(3), 2.0), ("A", d(3), d(3), 3.0), ("A", d(9), d(8), 9.0), (None, d(1), d(1), 7.0)], "k string, filed date, `end` date, v double")
    got = sorted((r["k"] or "", str(r["c"]), r["note"] or "", r["v"] or 0) for r in joins.asof_by(left, right, ["k"], "c", "filed", "end", "v").collect())
    assert got == [("", "2020-01-09", "y", 0), ("A", "2020-01-09", "", 2.0), ("A", "2020-01-09", "", 2.0), ("A", "None", "z", 0), ("B", "2020-01-09", "x", 0)]
    years = spark.createDataFrame([("A", dt.date(2019, 1, 1), dt.date(2018, 6, 1), 5.0), ("A", dt.date(2019, 6, 1), dt.date(2017, 6, 1), 6.0)], "k string, filed date, `end` date, v double")
    got = [r["v"] for r in joins.periods_back(left.where("k = 'A' and c is not null"), years, ["k"], "c", "filed", "end", "v", 1).collect()]
    assert got == [6.0, 6.0]


def test_search_orders_by_all_keys(spark):
    df = spark.createDataFrame([(1, 2), (0, 9), (1, 1), (0, 3)], "a int, b int")
    e = Engine(spark, {"t": df})
    rows = lambda order: [tuple(r) for r in e.run("search", {"from": "t", "orderBy": order}).collect()]
    assert rows(["a", "b"]) == [(0, 3), (0, 9), (1, 1), (1, 2)]
    assert rows([{"a": "desc"}, {"field": "b", "desc": True}]) == [(1, 2), (1, 1), (0, 9), (0, 3)]


def test_predict_takes_every_condition(spark):
    rows = [(i, "abc"[i % 3], float(i), f"word{i % 2} other", "yes" if i % 3 == 0 and i < 40 else "no") for i in range(60)]
    df = spark.createDataFrame(rows, "id int, f string, x double, note string, cls string")
    e = Engine(spark, {"t": df}, {"note"})
    for where in ({"x": {"$lt": 40}}, {"$and": [{"f": "a"}, {"x": {"$lt": 40}}]}, {"$or": [{"f": "a"}, {"f": "b"}]}, {"$not": {"f": "c"}}, {"note": "word1 other"}, {"x": 3.0}, {}):
        for config in ({}, {"ai": "high"}):
            got = e.run("predict", {"from": "t", "where": where, "predict": "cls", "config": config, "select": ["feature", "$p", "$why"]}).collect()
            assert sum(r["p"] for r in got) == pytest.approx(1) and {r["feature"] for r in got} == {"yes", "no"}
            for r in got:
                product = 1.0
                for w in r["why"]:
                    product *= w["value"]
                assert product == pytest.approx(r["p"])
    with pytest.raises(QueryError):
        e.run("predict", {"from": "t", "where": {"$or": [{"$on": {"prop": {"f": "a"}, "on": {"x": 1}}}]}, "predict": "cls"})


def test_large_count_tables_give_the_same(spark):
    rows = [(i, i % 3, "xy"[i % 2], "abc"[i % 3] if i % 5 else None, str(i % 7)) for i in range(120)]
    df = spark.createDataFrame(rows, "id int, fold int, cls string, f string, g string")
    table = lambda out: {tuple(r)[:-1]: [round(x, 9) for x in r[-1]] for r in out.select("id", "p").collect()}
    for run in (
        lambda b: bayes.cross_validate(df, ["f", "g"], ["x", "y"], [0, 1, 2], bound=b),
        lambda b: bayes.predict(df.where("fold > 0"), df.where("fold = 0"), ["f", "g"], ["x", "y"], bound=b),
    ):
        assert table(run(None)) == table(run(3))
    sweep = lambda b: sorted((r["k"], r["n"], round(r["logloss"], 9), r["accuracy"]) for r in bayes.prefix_scores(df, ["f", "g"], ["x", "y"], [0, 1, 2], [1, 2], bound=b).collect())
    assert sweep(None) == sweep(3)
    told = lambda b: sorted((r["id"], r["c"], r["field"], r["value"], round(r["lift"], 9)) for r in bayes.explain(df, df.where("fold = 0"), ["f", "g"], ["x", "y"], bound=b).collect())
    assert told(None) == told(3)


def slow_clusters(near, features, linkage, floor):
    """Merging by the definition of linkage: every two members of two clusters, each time anew."""
    clusters = [[f] for f in features]
    while True:
        best = None
        for i in range(len(clusters)):
            for j in range(i + 1, len(clusters)):
                found = [near[frozenset((a, b))] for a in clusters[i] for b in clusters[j]]
                nmi, gain = ([f[k] for f in found] for k in (0, 1))
                nmi, gain = (min(nmi), min(gain)) if linkage == "complete" else (sum(nmi) / len(nmi), sum(gain) / len(gain))
                if gain > 0 and nmi >= floor and (best is None or nmi > best[0] + 1e-12):
                    best = nmi, i, j
        if best is None:
            return sorted(sorted(c) for c in clusters)
        _, i, j = best
        clusters[i] += clusters.pop(j)


@pytest.mark.parametrize("linkage", ["complete", "average"])
def test_cluster_features_against_brute_force(spark, monkeypatch, linkage):
    import random

    rng, features = random.Random(9), list("abcdefgh")
    for _ in range(6):
        near = {frozenset((a, b)): (rng.random(), rng.uniform(-1, 5)) for a in features for b in features if a < b}
        pairs = spark.createDataFrame([(min(p), max(p), *v) for p, v in near.items()], "fa string, fb string, nmi double, mdl_gain double")
        monkeypatch.setattr(information, "mutual_information", lambda df, f, pairs=pairs: pairs)
        got = information.cluster_features(None, features, linkage, 0.3)
        assert sorted(sorted(c) for c in got) == slow_clusters(near, features, linkage, 0.3)


def test_quantiles_and_grouped_ranks(spark):
    import numpy as np

    rows = [(k, float(x)) for k, n in (("a", 101), ("b", 1), (None, 50), ("c", 4)) for x in np.random.default_rng(3).integers(0, 30, n)] + [("d", None)]
    df = spark.createDataFrame(rows, "k string, x double")
    got = {r["k"]: r["q"] for r in ranking.quantiles(df, ["k"], "x", [0.0, 0.25, 0.5, 0.9, 1.0]).collect()}
    by = {}
    for k, x in rows:
        if x is not None:
            by.setdefault(k, []).append(x)
    assert set(got) == set(by) and all(np.allclose(got[k], np.quantile(v, [0.0, 0.25, 0.5, 0.9, 1.0])) for k, v in by.items())
    placed = ranking.grouped_rank(df.where("x is not null"), ["k"], [F.col("x")], "r", "n").collect()
    for k, v in by.items():
        own = [r for r in placed if r["k"] == k]
        assert sorted(r["r"] for r in own) == list(range(1, len(v) + 1)) and {r["n"] for r in own} == {len(v)}
        assert [r["x"] for r in sorted(own, key=lambda r: r["r"])] == sorted(v)
    assert ranking.quantiles(df.where("x > 99"), [], "x", [0.5]).count() == 1


def test_similar_against_all_pairs(spark):
    import math
    import random

    rng = random.Random(11)
    rows = [(i, rng.choice("ab"), rng.choice(["x", "y", None]), rng.choice([None, "o"])) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, f string, g string, o string")
    n = {c: {v: sum(r[i] == v for r in rows) for v in {r[i] for r in rows}} for c, i in (("f", 1), ("g", 2))}
    got = {}
    for r in ranking.similar(df, df.where("id % 4 = 0"), "id", ["f", "g"], 5, "o").orderBy("focal", "rank").collect():
        got.setdefault(r["focal"], []).append(r["id"])
    for focal in rows[::4]:
        scores = [(-round(sum(math.log(60 / n[c][focal[i]]) for c, i in (("f", 1), ("g", 2)) if focal[i] is not None and focal[i] == r[i]), 9), r[0]) for r in rows
                  if r[0] != focal[0] and r[3] and any(focal[i] is not None and focal[i] == r[i] for i in (1, 2))]
        assert got[focal[0]] == [i for _, i in sorted(scores)[:5]]


@pytest.mark.parametrize("head", [1, 32])
def test_similar_on_many_fields(spark, head):
    """Sixteen fields of which some are common and some rare; nulls, equal rows and ties."""
    import math
    import random

    rng, names = random.Random(12), [f"f{i}" for i in range(16)]
    rows = [(i, *[rng.choice([None, *range(1 + j)]) for j in range(16)]) for i in range(150)]
    rows += [(1000 + i, *r[1:]) for i, r in enumerate(rows[:20])]
    df = spark.createDataFrame([tuple(x if x is None else (x if c == 0 else str(x)) for c, x in enumerate(r)) for r in rows], "id int, " + ", ".join(f"{n} string" for n in names))
    n = [{v: sum(r[j + 1] == v for r in rows) for v in {r[j + 1] for r in rows}} for j in range(16)]
    got = {}
    for r in ranking.similar(df, df.where("id % 7 = 0"), "id", names, 6, head=head).orderBy("focal", "rank").collect():
        got.setdefault(r["focal"], []).append((r["id"], round(r["score"], 6)))
    for f in (r for r in rows if r[0] % 7 == 0):
        scores = []
        for r in rows:
            shared = [math.log(len(rows) / n[j][f[j + 1]]) for j in range(16) if f[j + 1] is not None and f[j + 1] == r[j + 1]]
            if r[0] != f[0] and shared:
                scores.append((-round(sum(shared), 9), r[0]))
        assert got[f[0]] == [(i, round(-s, 6)) for s, i in sorted(scores)[:6]]


def test_lifts_and_their_base_come_from_one_scan(spark):
    rows = [(1, "a", None), (1, "a", "x"), (0, "b", "x"), (0, None, "x"), (None, "a", "x")]
    df = spark.createDataFrame(rows, "t int, f string, g string")
    got = lift.lift_table(df, ["f", "g"], F.col("t"))
    assert {(r["field"], r["value"]): (r["n"], r["lift"]) for r in got.collect()} == {("f", "a"): (2, 2.0), ("f", "b"): (1, 0.0), ("g", "x"): (3, pytest.approx(2 / 3))}
    plan = got._jdf.queryExecution().toString().partition("Final Plan")[2].partition("Initial Plan")[0]
    assert plan.count("Generate explode") == 1 and "ReusedExchange" in plan
    assert lift.lift_table(df.where("t is null"), ["f"], F.col("t")).count() == 0
    assert lift.two_way_lift(df, ["f"], F.col("t") == 1, F.col("t") == 0, 1).count() == 2
