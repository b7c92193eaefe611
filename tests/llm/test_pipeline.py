"""The pipeline's stages against their operators on a small corpus, planted cases, and edge cases."""

import re
from collections import Counter

import corpus_pipeline
import numpy as np
from presage.llm import byte_cnn, language_mixture, near_copies, queries
from presage.llm.common import crc_mod
from pyspark.sql import functions as F
from test_operators import slow_mixture, slow_quality

SF = "/root/testdata/sf0.01"


def eight_tenths(texts):
    """Groups of ids by all pairs of five-word shingle sets that share a shingle."""
    sets, postings = {}, {}
    for d, text in texts.items():
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        sets[d] = s = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
        for x in s:
            postings.setdefault(x, []).append(d)
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for d, s in sorted(sets.items()):
        for e, n in Counter(e for x in s for e in postings[x] if e < d).items():
            a, b = find(d), find(e)
            if a != b and 5 * n >= 4 * (len(s) + len(sets[e]) - n):
                root[max(a, b)] = min(a, b)
    groups = {}
    for d in sets:
        groups.setdefault(find(d), []).append(d)
    return list(groups.values())


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = corpus_pipeline.quality(spark, docs, SF)
    assert good.columns == docs.columns
    kept = {r["doc_id"] for r in good.select("doc_id").collect()}
    assert sum(d in kept for d, q in labels.items() if q == 1) >= 0.98 * sum(labels.values())
    assert sum(d in kept for d, q in labels.items() if q == 0) <= 0.5 * sum(1 - q for q in labels.values())
    spoken = corpus_pipeline.language(spark, docs, SF)
    assert spoken.columns == docs.columns and spoken.count() >= 0.99 * docs.count()
    single = corpus_pipeline.near_duplicates(spark, docs, SF)
    least = [min(g) for g in eight_tenths({r["doc_id"]: r["text"] for r in docs.collect()})]
    assert single.columns == docs.columns
    assert sorted(r[0] for r in single.select("doc_id").collect()) == sorted(least)
    packed = corpus_pipeline.pack(spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.count()


def test_filters_against_brute_force(spark):
    """Quality and language keep what plain loops over the fitted models keep."""
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    short = {r["doc_id"]: r["text"] for r in docs.collect() if r["text"] and len(r["text"]) < 700}
    net = byte_cnn.fit(*byte_cnn.sample(docs, labels.where(crc_mod("doc_id", 5) != 0)))
    p = {d: slow_quality(net, text.encode()) for d, text in short.items()}
    good = {r["doc_id"] for r in corpus_pipeline.quality(spark, docs, sf).collect()}
    assert p and all((d in good) == (x >= 0.3) for d, x in p.items() if abs(x - 0.3) > 1e-3)
    # Texts of one language, and of up to five, whose greatest share is small.
    by = {}
    for r in docs.collect():
        if r["doc_id"] in short:
            by.setdefault(r["lang"], r["text"][:300])
    mixed = [" ".join(list(by.values())[i : i + k]) for k in (1, 2, 3, 5) for i in range(len(by))]
    rows = spark.createDataFrame([(10**9 + i, t, None, None, len(t)) for i, t in enumerate(mixed)], docs.select("doc_id", "text", "lang", "source", "n_chars").schema)
    all_ = docs.select(*rows.columns).unionByName(rows)
    model = language_mixture.fit(all_, crc_mod("doc_id", 4) != 2)
    share = {10**9 + i: max(slow_mixture(model, t).values()) for i, t in enumerate(mixed)}
    kept = {r["doc_id"] for r in corpus_pipeline.language(spark, all_, sf).collect()}
    assert any(x < 0.4 for x in share.values()) and all((d in kept) == (x >= 0.4) for d, x in share.items() if abs(x - 0.4) > 0.01)


def test_run_is_its_stages(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, rows.select(key).collect())) == sorted(map(tuple, docs.select(key).collect()))


def test_copies_and_odd_rows(spark):
    base = "Some words that make a sentence of fair length, and then some more of them to follow. " * 4
    rows = [(1, base), (2, base), (2, base), (3, base + "End."), (4, None), (5, ""), (6, "123 456"), (None, base)]
    docs = spark.createDataFrame([(d, t, "en", "s", 1, "x") for d, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, score string")
    single = corpus_pipeline.near_duplicates(spark, docs, SF).collect()
    assert sorted(r["doc_id"] for r in single if r["doc_id"] is not None and r["text"] == base) == [1]
    assert sum(r["doc_id"] is None for r in single) == 1
    spoken = {r["doc_id"] for r in corpus_pipeline.language(spark, docs, SF).collect()}
    assert not spoken & {4, 5, 6}
    none = docs.where(F.col("doc_id") < 0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0


def test_every_query_is_registered(spark):
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert set(queries.ORACLE_SQL) <= set(names)


def test_near_copies_at_eight_tenths(spark):
    """The stage against all pairs of five-word shingle sets, and pairs on both sides of 0.8."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    word = lambda a, b: [f"w{i}" for i in range(a, b)]
    planted = {
        10**6: word(0, 100), 10**6 + 1: word(0, 90) + word(1000, 1010),  # 86 of 106 shingles: 0.811
        10**6 + 2: word(2000, 2100), 10**6 + 3: word(2000, 2089) + word(3000, 3011),  # 85 of 107: 0.794
    }
    extra = spark.createDataFrame([(d, " ".join(w), "en", "s", 1) for d, w in planted.items()], docs.schema)
    docs = docs.unionByName(extra)
    groups = eight_tenths({r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()})
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, SF).select("doc_id").collect()}
    assert kept == {min(g) for g in groups}
    assert kept & set(planted) == {10**6, 10**6 + 2, 10**6 + 3}


def test_near_copies_of_large_cells_and_groups(spark, monkeypatch):
    """Cells and groups dealt into parts give the groups of those held whole."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 500")
    base = [f"w{i}" for i in range(400)]
    near = [(10**6 + i, " ".join(base[: 390 - i] + [f"x{i}"] + base[391 - i :]), "en", "s", 1) for i in range(40)]
    docs = docs.unionByName(spark.createDataFrame(near, docs.schema))
    whole = sorted(tuple(r) for r in near_copies.near_copies(docs).select("doc_id", "component_id").collect())
    assert all(c == 10**6 for d, c in whole if d >= 10**6)
    monkeypatch.setattr(near_copies, "SHINGLES", 100)
    monkeypatch.setattr(near_copies, "CELL", 3)
    assert sorted(tuple(r) for r in near_copies.near_copies(docs).select("doc_id", "component_id").collect()) == whole


def test_near_copies_candidates_against_all_pairs():
    """Planted pairs at similarity 0.8: how many share a cell and lie within the radius."""
    rng = np.random.default_rng(4)
    found, pairs, chosen = 0, 400, near_copies.grids(200_000)
    for _ in range(pairs):
        own = rng.integers(0, 1 << 62, 360).astype(np.uint64)
        fps = [near_copies.fingerprint(np.unique(x)) for x in (own[:324], own[36:])]  # 288 of 360: 0.8
        bits = [np.unpackbits(f.view(np.uint8), bitorder="little") for f in fps]
        share = any((bits[0][at] == bits[1][at]).all() for at in chosen)
        found += share and bool(near_copies.near(fps[0][None, :2], fps[1][None, :2])[0])
    assert found >= 0.92 * pairs


def test_repeated_doc_id_keeps_each_groups_text(spark):
    """Rows of one doc_id in different groups: each group keeps one of its own texts, whatever the order."""
    a, b = (" ".join(f"{c}{i}" for i in range(100)) for c in "ab")
    rows = [(3, a), (5, a + " end"), (5, b), (5, b + " end"), (5, b)]
    for some in (rows, rows[::-1]):
        docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in some], "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(1)
        got = sorted((r["doc_id"], r["text"][:2]) for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect())
        assert got == [(3, "a0"), (5, "b0")]
