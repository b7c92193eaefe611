"""The data source connector, wide pair counts, feature ranking and portfolios against plain versions."""

import json
import math
import random
from collections import Counter
from datetime import date
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from presage.functions import analysis
from presage.operators import bayes, information, ranking
from presage.plans import q_sources, registry
from presage.sources import connector, readers, sinks


def put(root, name, said, text):
    (root / name).mkdir(parents=True)
    if said is not None:
        (root / name / "metadata.json").write_text(json.dumps(said))
    if text is not None:
        (root / name / "text.txt").write_text(text)


def test_filings_are_filtered_before_texts_are_opened(spark, tmp_path):
    connector.register(spark)
    root = tmp_path / "filings"
    put(root, "a", {"ticker": "A", "form": "10-K", "filed": "2020-01-02", "accession": "1"}, "annual")
    put(root, "b", {"ticker": "B", "form": "8-K", "filed": "not a date"}, "event")
    put(root, "c", {"ticker": "C", "form": "10-K", "filed": "2021-05-01"}, None)
    put(root, "d", None, "no metadata")
    read = lambda: spark.read.format("filings").option("path", f"file:{root}").option("folders", 2).load()
    rows = {tuple(r) for r in read().collect()}
    assert rows == {("A", "10-K", date(2020, 1, 2), "1", "annual"), ("B", "8-K", None, None, "event"), ("C", "10-K", date(2021, 5, 1), None, None)}
    (root / "a" / "text.txt").unlink()
    (root / "a" / "text.txt").mkdir()  # opening it fails
    assert [r["ticker"] for r in read().where("form = '8-K'").collect()] == ["B"]
    assert [r["ticker"] for r in read().where(F.col("filed") > F.lit("2020-06-01").cast("date")).collect()] == ["C"]
    assert read().where("ticker in ('B', 'C') and text is not null").count() == 1
    with pytest.raises(Exception, match="text.txt"):
        read().where("ticker = 'A'").collect()
    (tmp_path / "none").mkdir()
    assert spark.read.format("filings").option("path", str(tmp_path / "none")).load().count() == 0


def test_folders_of_many_filings_are_read_alike(spark, tmp_path):
    connector.register(spark)
    rows = [(f"T{i % 5}", "10-K" if i % 2 else "8-K", f"2020-01-{1 + i % 28:02d}", str(i), None if i % 7 == 0 else "" if i % 7 == 1 else f"té\nxt €{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "ticker string, form string, filed string, accession string, text string")
    sinks.write_filings(df, f"file:{tmp_path}/t", rows=50)
    assert len(list((tmp_path / "t").iterdir())) <= 6
    put(tmp_path / "t", "one", {"ticker": "T9", "form": "10-K", "filed": "2021-05-01", "accession": "x"}, "a wholé text")
    want = sorted(((t, f, date.fromisoformat(d), a, x) for t, f, d, a, x in [*rows, ("T9", "10-K", "2021-05-01", "x", "a wholé text")]), key=lambda r: r[3])
    read = lambda: spark.read.format("filings").option("path", f"file:{tmp_path}/t").load()
    assert sorted(map(tuple, read().collect()), key=lambda r: r[3]) == want
    assert sorted(map(tuple, readers.filing_folders(spark, f"file:{tmp_path}/t").collect()), key=lambda r: r[3]) == want
    assert sorted(map(tuple, read().where("ticker = 'T3' and form = '8-K'").collect()), key=lambda r: r[3]) == [r for r in want if r[:2] == ("T3", "8-K")]


@pytest.mark.parametrize("name", ["filing_scan", "filing_source"])
def test_filing_queries_write_few_files(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(q_sources, "new_path", lambda spark, tag: f"file:{tmp_path}/{tag}")
    assert registry.QUERIES[name](spark, "/root/testdata/sf0.001").count()
    customers = spark.read.parquet("/root/testdata/sf0.001/customer.parquet").count()
    assert 0 < sum(1 for p in tmp_path.rglob("*") if p.is_file()) < customers


def test_batches_count_once_they_are_committed(spark, tmp_path):
    connector.register(spark)
    path = str(tmp_path / "t")
    df = spark.range(2500).select("id", F.when(F.col("id") % 3 > 0, F.concat(F.lit("v"), "id")).alias("v")).repartition(2)
    back = lambda: spark.read.format("batches").schema("id bigint, v string").option("path", path).load()
    write = lambda d, mode, **o: d.write.format("batches").option("path", path).options(**o).mode(mode).save()
    write(df, "overwrite", rows=1000)
    files = connector.committed(path)
    assert len(files) == 4 and all(sum(1 for _ in open(f"{path}/{f}")) <= 1000 for f in files)
    assert sorted(map(tuple, back().collect())) == sorted(map(tuple, df.collect()))
    (tmp_path / "t" / "batch-lost.jsonl").write_text('{"id": -1}\n')  # of a task that failed
    write(df.limit(5), "append")
    assert back().count() == 2505 and back().where("id < 0").count() == 0
    boom = F.udf(lambda i: 1 // (i - 2), "int")
    with pytest.raises(Exception):  # noqa: B017
        write(spark.range(5).select("id", boom("id").cast("string").alias("v")), "overwrite")
    assert back().count() == 2505
    write(df.limit(3), "overwrite")
    assert back().count() == 3


def test_pair_counts_of_many_columns(spark, monkeypatch):
    """Sixty-five columns by matrices, over several strides, against counting by hand and the plan for few columns."""
    monkeypatch.setattr(information, "STRIDE", 64)
    rng = random.Random(3)
    names = [f"c{i}" for i in range(65)]
    rows = [tuple(rng.choice([None, "", *map(str, range(1 + i % 7))]) if i else str(rng.random()) for i in range(65)) for _ in range(150)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names)).repartition(2)
    got = {tuple(r)[:4]: r["n"] for r in information.pair_counts(df, names).select("fa", "fb", "va", "vb", "n").collect()}
    said = [[x or "(missing)" for x in r] for r in rows]
    want = Counter((names[a], names[b], r[a], r[b]) for r in said for a, b in combinations(range(65), 2))
    assert got == dict(want)
    few = names[1:6]
    shown = lambda wide: sorted(map(tuple, information.pair_counts(df, few, wide).select("fa", "fb", "va", "vb", "n").collect()))
    assert shown(2) == shown(8)
    assert information.pair_counts(df.where("false"), names).count() == 0


def graded(spark, n=200):
    rng = random.Random(5)
    rows = [(i, rng.randrange(3), c := rng.choice("xyz"), c if rng.random() < 0.6 else rng.choice("xyz"), rng.choice(["p", "q", None]), rng.choice("ab"), rng.uniform(-5, 9), 2000 + i % 4) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id int, fold int, cls string, f string, g string, h string, ret double, year int")


def test_features_are_ranked_by_held_out_gain(spark):
    """From the count table alone, as scoring every row by each single feature says; alike beyond the driver's bound."""
    rows, df = graded(spark)
    fields, classes = ["h", "g", "f"], ["x", "y", "z"]
    want = {}
    for f in fields:
        p = {r["id"]: r["p"] for r in bayes.cross_validate(df, [f], classes, [0, 1, 2]).collect()}
        want[f] = sum(-math.log(p[r[0]][classes.index(r[2])]) for r in rows) / len(rows)
    for bound in (None, 2):
        got = bayes.rank_features(df, fields, classes, [0, 1, 2], bound=bound).collect()
        assert {r["field"]: round(r["logloss"], 9) for r in got} == {f: round(x, 9) for f, x in want.items()}
        assert [r["field"] for r in got] == sorted(fields, key=lambda f: want[f]) and got[0]["field"] == "f" and all(r["n"] == 200 for r in got)
        assert len({round(r["gain"] + r["logloss"], 9) for r in got}) == 1


def test_many_models_of_one_scan(spark):
    rows, df = graded(spark)
    sets, classes = {"one": ["f"], "two": ["g", "h"], "all": ["f", "g", "h"]}, ["x", "y", "z"]
    tables = []
    for bound in (None, 2):
        out = bayes.subset_scores(df, ["f", "g", "h"], sets, classes, [0, 1, 2], bound=bound, keep=["ret", "year"])
        assert set(out.columns) >= {"ret", "year"}
        tables.append({r["id"]: {s: [round(x, 9) for x in r[f"p_{s}"]] for s in sets} for r in out.collect()})
    assert tables[0] == tables[1]
    for s, fields in sets.items():
        alone = {r["id"]: [round(x, 9) for x in r["p"]] for r in bayes.cross_validate(df, fields, classes, [0, 1, 2]).collect()}
        assert alone == {i: t[s] for i, t in tables[0].items()}


def test_portfolios_by_many_scores(spark):
    rows, df = graded(spark)
    scores = F.array(*[F.struct(F.lit(n).alias("name"), F.round(x, 3).alias("score")) for n, x in (("a", F.col("ret") % 3), ("b", -F.col("ret")))])
    got = {(r["name"], r["size"]): (round(r["mean"], 9), r["share_beating"]) for r in ranking.fund_table(df.select("id", "ret", "year", scores.alias("s")), "s", ["name"], "id", "ret", "year", (3, 10)).collect()}
    market = {y: sum(r[6] for r in rows if r[7] == y) / sum(r[7] == y for r in rows) for y in range(2000, 2004)}
    own = {(r["id"], s["name"]): s["score"] for r in df.select("id", scores.alias("s")).collect() for s in r["s"]}
    for name in "ab":
        order = sorted(rows, key=lambda r: (-own[r[0], name], r[0]))
        for size in (3, 10):
            top = order[:size]
            assert got[name, size] == (round(sum(r[6] for r in top) / size, 9), sum(r[6] > market[r[7]] for r in top) / size)
    means = {r["fold"]: r["means"] for r in ranking.fold_means(df, "fold", "cls", "ret", ["x", "y", "z"], [0, 1, 2]).collect()}
    for k in range(3):
        for i, c in enumerate("xyz"):
            own_ = [r[6] for r in rows if r[1] != k and r[2] == c]
            assert means[k][i] == pytest.approx(sum(own_) / len(own_))


def test_only_words_like_a_term_are_stemmed(spark):
    rng, ends = random.Random(3), ["", "s", "es", "ies", "ing", "ed", "ly", "e", "y", "sses", "lies", "nning", "ily", "eed", "'s"]
    words = ["".join(rng.choice("aerstyl") for _ in range(rng.randrange(1, 6))) + rng.choice(ends) for _ in range(3000)]
    df = spark.createDataFrame([(w,) for w in words] + [(None,), ("",), ("The Reing is of; stndeas é",)], "t string")
    stems = [r[0] for r in df.select(F.explode(analysis.terms(F.col("t"), "english"))).distinct().collect()]
    for wanted in (stems[:3], stems[3:60], ["re", "stndea"], []):
        asked = F.array(*[F.lit(w) for w in wanted]).cast("array<string>")
        whole = analysis.terms(F.col("t"), "english")
        each = F.transform(asked, lambda w: F.size(F.filter(whole, lambda x: x == w)))
        found = analysis.term_counts(F.col("t"), wanted, "english")
        got = df.select(analysis.has_term(F.col("t"), wanted, "english").alias("a"), F.arrays_overlap(whole, asked).alias("b"), found["counts"].alias("c"), each.alias("d"), found["size"].alias("e"), F.size(whole).alias("f"))
        bad = got.where("not (a <=> b) or (b is not null and (c <> d or e <> f))").collect()
        assert not bad
    like = analysis.near_terms(F.array(F.lit("running"), F.lit("stone"), F.lit("sting")), ["ston"], "english")
    assert spark.range(1).select(like).first()[0] == ["ston"]  # "sting" kept as "st" before: its ending was cut for nothing


def test_schools_score_and_store_all_sets_at_once(spark, monkeypatch):
    kept, store = [], ranking.materialize
    monkeypatch.setattr(ranking, "materialize", lambda df, tag: kept.append(tag) or store(df, tag))
    assert registry.QUERIES["schools"](spark, "/root/testdata/sf0.001").count() == 4
    assert kept == ["scores"]  # one for each of the four sets before


def test_fund_means_are_those_of_the_best_rows(spark):
    rng = random.Random(4)
    rows = [(i, rng.uniform(-1, 1), float(rng.randrange(6)), rng.random()) for i in range(150)]
    df = spark.createDataFrame(rows, "id bigint, ret double, a double, b double")
    got = {r["name"]: (r["top5"], r["top40"]) for r in ranking.fund_means(df, ["a", "b"], "id", "ret", (5, 40)).collect()}
    for at, name in ((2, "a"), (3, "b")):
        best = [r[1] for r in sorted(rows, key=lambda r: (-r[at], r[0]))]
        assert got[name] == pytest.approx((sum(best[:5]) / 5, sum(best[:40]) / 40))
    assert ranking.fund_means(df.where("id < 0"), ["a"], "id", "ret").count() == 0
