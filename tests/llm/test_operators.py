"""The training-data operators against brute force, exact round trips and held-out accuracy, and their edge cases."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from presage.llm import bpe, byte_cnn, components, elias_fano, language_mixture, multiset_hash, ngram_trie, packing, prefix_tree, queries, simhash, topk_search, warc
from presage.llm.common import crc_mod

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
BYTE, WORDS = queries.tokenizer_path("byte_bpe_50k.json"), queries.tokenizer_path("word_bpe_49k.json")

#: Null and empty texts, ties and repeated rows, one long text, odd characters.
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "One two. Three!\nfour"), (4, "One two. Three!\nfour"), (5, "One two. Three!\nfour"),
    (6, "İstanbul ŉ ſ  x 'll ok'RE's   日本語 é <|endoftext|> x"), (7, "word " * 30_000), (8, "ab" * 9_000 + " tail"), (None, "no id here. at all"), (9, "A"),
]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame([(i, t, "x", 1.0) for i, t in ODD], "doc_id bigint, text string, score string, fp double")


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string")


def docs_of(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# 1: prefix tree


def expected_chat(rows):
    by = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by.setdefault(conv, []).append((role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for r, t in turns)
        out[conv] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


@pytest.mark.parametrize("budget", [200, 1 << 20])
def test_chat_round_trip(spark, budget):
    rng = random.Random(1)
    parts = ["\\", "<|", "</s>", "[INST]", "<|turn|>", "<|body|>", "hi\n", "é", "", " "]
    rows = [(c, t, rng.choice(["user", "assistant", "<|end|>", None]), rng.choice([None, "same", "".join(rng.choices(parts, k=5))])) for c in range(60) for t in range(rng.randint(1, 6))]
    rows += [(90, t, "user", f"deep {t}") for t in range(300)] + [(91, t, "user", f"deep {t}") for t in range(299)] + [(0, 0, "user", "twice"), (0, 0, "user", "twice")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv_id bigint, turn bigint, role string, text string, node int")
    blocks = prefix_tree.format_conversations(df, budget)
    got = {r["conv_id"]: tuple(r)[1:5] for r in prefix_tree.read_back(blocks).collect()}
    assert got == expected_chat(rows)


def test_chat_tree_shares_turns_and_masks_ancestors(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a"), (2, 1, "assistant", "c"), (2, 2, "user", "d"), (3, 0, "user", "a")]
    [block] = prefix_tree.format_conversations(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string").coalesce(1)).collect()
    nodes = block["nodes"]
    assert len(nodes) == 4 and block["text"].count("user<|body|>a") == 1
    for n in nodes:
        up, path = n["parent"], []
        while up >= 0:
            path.append(nodes[up])
            up = nodes[up]["parent"]
        assert n["position"] == sum(p["end"] - p["start"] for p in path)
        seen = {i for a in n["attends"] for i in range(a["start"], a["end"])}
        assert seen == {i for p in path for i in range(p["start"], p["end"])}
        assert all(p["end"] <= n["start"] for p in path)
    loss = [block["text"][n["loss_start"] : n["loss_end"]] for n in nodes]
    assert sorted(x for x in loss if x) == ["b", "c"]


def test_chat_tokens_once_a_node(spark):
    """Ids of shared turns stand once; positions, ancestors and the mask count tokens."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BYTE)
    rows = [(1, 0, "user", "hello there"), (1, 1, "assistant", "general <|end|> é"), (2, 0, "user", "hello there"), (2, 1, "assistant", "other words"), (2, 2, "user", "more")]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string").coalesce(1)
    [block] = prefix_tree.format_conversations(df, tokenizer=BYTE).collect()
    ids, nodes = block["ids"], block["nodes"]
    assert len(nodes) == 4 and [n["token_start"] for n in nodes] == [0, *[n["token_end"] for n in nodes[:-1]]] and nodes[-1]["token_end"] == len(ids)
    said = []
    for n in nodes:
        text = lambda a, b: t.decode(ids[a:b], skip_special_tokens=False)
        assert text(n["token_start"], n["token_end"]) == block["text"][n["start"] : n["end"]]
        assert text(n["loss_token_start"], n["loss_token_end"]) == block["text"][n["loss_start"] : n["loss_end"]]
        said.append(prefix_tree.unescape(text(n["loss_token_start"], n["loss_token_end"])))
        up, path = n["parent"], []
        while up >= 0:
            path.append(nodes[up])
            up = nodes[up]["parent"]
        assert n["position"] == sum(p["token_end"] - p["token_start"] for p in path)
        assert {i for a in n["attends"] for i in range(a["start"], a["end"])} == {i for p in path for i in range(p["token_start"], p["token_end"])}
    assert sorted(x for x in said if x) == ["general <|end|> é", "other words"]


@pytest.mark.parametrize("budget", [200, 1 << 20])
def test_chat_token_trees_of_random_conversations(spark, budget):
    """Each leaf's path gives its conversation's tokens, positions from 0 on, and the ancestors' intervals, in blocks of any size."""
    from tokenizers import Tokenizer

    t, rng = Tokenizer.from_file(WORDS), random.Random(11)
    texts = ["hello there", "</s> ok", "é 日本 \\ x", "", "a longer answer of some words", "no"]
    said = {c: [(rng.choice(["user", "assistant"]), rng.choice(texts)) for _ in range(rng.randint(1, 6))] for c in range(60)}
    rows = [(c, i, *turn) for c, turns in said.items() for i, turn in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string")

    def parts(role, text):
        whole, a, b = prefix_tree.format_turn(role, text)
        body = len(whole) - len(prefix_tree.CLOSE)
        own = [t.encode(x, add_special_tokens=False).ids for x in (whole[:a], whole[a:body], whole[body:])]
        return own, [len(own[0]), len(own[0]) + (len(own[1]) if b > a else 0)]

    seen = []
    for block in prefix_tree.format_conversations(df, budget=budget, tokenizer=WORDS).collect():
        ids, nodes = block["ids"], block["nodes"]
        for leaf in block["leaves"]:
            path, i = [], leaf["node"]
            while i >= 0:
                path.insert(0, nodes[i])
                i = nodes[i]["parent"]
            assert len(path) == len(said[leaf["conv_id"]])
            at, before = 0, []
            for n, turn in zip(path, said[leaf["conv_id"]]):
                own, mask = parts(*turn)
                assert ids[n["token_start"] : n["token_end"]] == sum(own, [])
                assert [n["loss_token_start"] - n["token_start"], n["loss_token_end"] - n["token_start"]] == mask
                assert n["position"] == at
                assert [i for a in n["attends"] for i in range(a["start"], a["end"])] == before
                at += n["token_end"] - n["token_start"]
                before = [*before, *range(n["token_start"], n["token_end"])]
            seen.append(leaf["conv_id"])
    assert sorted(seen) == sorted(said)


def test_chat_control_strings():
    rng = random.Random(2)
    for _ in range(3000):
        s = "".join(rng.choices(["\\", "<", "|", "s>", "</s>", "[INST]", "[", "/INST]", "<|turn|>", "a", "\n"], k=8))
        e = prefix_tree.escape(s)
        assert prefix_tree.unescape(e) == s and not any(c in e for c in prefix_tree.CONTROL)


def test_chat_empty(spark):
    assert prefix_tree.read_back(prefix_tree.format_conversations(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string"))).count() == 0


# 2: SimHash


def slow_fingerprint(text):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(pairs):
    ids, fps = [p[0] for p in pairs], [p[1] for p in pairs]
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        r = find(i)
        least[r] = min(least.get(r, d), d)
    return [least[find(i)] for i in range(len(ids))]


def test_simhash_fingerprints(spark):
    texts = [r["text"] for r in docs_of(spark).collect()][:80] + [None, "", " ", "A b", "a B c d", "x " * 20_000]
    assert [simhash.fingerprint(t) for t in texts] == [slow_fingerprint(t) for t in texts]


def test_simhash_components(spark, odd, none):
    got = simhash.near_duplicates(docs_of(spark)).collect()
    pairs = [(r["doc_id"], r["fp"] % 2**64) for r in got]
    assert [r["component_id"] for r in got] == slow_components(pairs)
    rows = {r["doc_id"]: r for r in simhash.near_duplicates(odd).collect()}
    assert simhash.near_duplicates(odd).count() == len(ODD)
    unnamed = spark.createDataFrame([(None, "one two three four five"), (None, "one two three four five")], "doc_id bigint, text string")
    assert [r["component_id"] for r in simhash.near_duplicates(unnamed).collect()] == [None, None]
    linked = simhash.near_duplicates(unnamed.unionByName(unnamed.withColumn("doc_id", F.lit(3).cast("bigint")))).collect()
    assert [r["component_id"] for r in linked] == [3] * 4
    assert rows[5]["component_id"] == 4 and rows[1]["fp"] == rows[2]["fp"] == rows[3]["fp"] == 0 and rows[3]["component_id"] == 1
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("cell", [1 << 14, 3])
def test_simhash_chains_and_dense_cells(spark, monkeypatch, cell):
    """Random chains of 4-bit steps and dense balls; with tiny cells, all by midpoints."""
    rng = random.Random(3)
    fps = []
    for _ in range(6):
        x = rng.getrandbits(64)
        for _ in range(12):
            fps.append(x)
            for b in rng.sample(range(64), 4):
                x ^= 1 << b
    ball = rng.getrandbits(64)
    fps += [ball ^ (1 << a) ^ (1 << b) for a in range(6) for b in range(6, 12)] + [rng.getrandbits(64) for _ in range(50)]
    fps = sorted(set(fps))
    monkeypatch.setattr(simhash, "CELL", cell)
    signed = simhash._signed(fps).tolist()
    import pyarrow as pa

    cells = [(c, f) for b in simhash._cells(iter([pa.RecordBatch.from_arrays([pa.array(signed)], ["fp"])])) for c, f in zip(*(x.to_pylist() for x in b.columns))]
    cells.sort(key=lambda x: x[0])
    batches = [pa.RecordBatch.from_arrays([pa.array([c for c, _ in cells[i : i + 7]]), pa.array([f for _, f in cells[i : i + 7]])], ["cell", "fp"]) for i in range(0, len(cells), 7)]
    a, b = [], []
    for x in simhash._links(iter(batches)):
        a += x.column(0).to_pylist()
        b += x.column(1).to_pylist()
    links = {(p, q) for p, q in zip(a, b) if q is not None}
    heavy = {p for p, q in zip(a, b) if q is None}
    assert bool(heavy) == (cell == 3)
    masks, middle = simhash._masks(), {}
    for p in heavy:
        for m in masks:
            middle.setdefault(p ^ m, []).append(p)
    links |= {(p, min(own)) for own in middle.values() for p in own}
    assert all(((p ^ q) % 2**64).bit_count() <= 4 for p, q in links)
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(list(links), "a bigint, b bigint")).collect()} if links else {}
    assert [got.get(s, s) for s in signed] == slow_components([(s, f) for s, f in zip(signed, fps)])


# 3: packing


@pytest.mark.parametrize("capacity", [7, 64, 2048])
def test_plan_uses_every_piece_once_and_few_sequences(capacity):
    rng = random.Random(capacity)
    sizes = Counter(rng.randint(1, capacity) if rng.random() < 0.5 else rng.randint(1, capacity // 4 + 1) for _ in range(5000))
    rows, load, used = packing.plan(dict(sizes), capacity), Counter(), Counter()
    for length, rank, each, first, n, offset in rows:
        assert rank == used[length]
        used[length] += each * n
        for s in range(first, first + n):
            assert load[s] == offset
            load[s] += each * length
    assert used == sizes and max(load.values()) <= capacity
    assert len(load) <= 1.01 * sum(k * n for k, n in sizes.items()) / capacity + 2
    assert packing.plan({}, capacity) == []


def best_fit_decreasing(sizes, capacity):
    """Loads of the sequences, a piece at a time: each goes to the fullest one that holds it."""
    loads = []
    for n in sorted(sizes.elements(), reverse=True):
        fits = [i for i, x in enumerate(loads) if x + n <= capacity]
        if fits:
            loads[max(fits, key=lambda i: loads[i])] += n
        else:
            loads.append(n)
    return sorted(loads)


@pytest.mark.parametrize("capacity", [1, 7, 40, 2048])
def test_plan_against_best_fit_of_single_pieces(capacity):
    rng = random.Random(capacity + 1)
    for _ in range(30):
        top = rng.randint(1, capacity)
        sizes = Counter(rng.randint(1, top) for _ in range(rng.randint(1, 250)))
        load = Counter()
        for length, _, each, first, n, _ in packing.plan(dict(sizes), capacity):
            for s in range(first, first + n):
                load[s] += each * length
        assert sorted(load.values()) == best_fit_decreasing(sizes, capacity)


def test_packing_documents(spark, odd, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    source = docs_of(spark).select("doc_id", "text").limit(60).unionByName(odd.select("doc_id", "text"))
    want = Counter()
    for r in source.collect():
        ids = [*t.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        for p, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[r["doc_id"], p, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    rows = packing.pack_documents(source, WORDS).collect()
    assert Counter(tuple(r)[:5] for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack_documents(none, WORDS).count() == 0


# 4: languages


def test_languages(spark, odd, none):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", F.lit(0).alias("share"))
    got = language_mixture.languages(rows, held_out=4).where(crc_mod("doc_id", 4) == 2).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.97 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got)
    model = language_mixture.fit(rows, F.lit(True))
    found = {r["doc_id"]: r for r in language_mixture.identify(odd.select("doc_id", "text"), model).collect()}
    assert all(found[i]["lang_pred"] == "und" and found[i]["score"] == 0 for i in (1, 2, 3))
    assert found[4]["lang_pred"] in model.names
    # Half of one language and half of another: both are found, in like shares.
    by = {x: max((r["text"] for r in got if r["lang"] == x and len(r["text"]) < 4000), key=len) for x in ("en", "fr")}
    n = min(map(len, by.values()))
    mixed = model.infer(by["en"][:n] + " " + by["fr"][:n])
    assert {model.names[i] for i in mixed} == {"en", "fr"} and all(0.3 < s < 0.7 for s in mixed.values())
    assert language_mixture.languages(none).count() == 0
    unlabelled = language_mixture.languages(odd.select("doc_id", "text", F.lit(None).cast("string").alias("lang"))).collect()
    assert len(unlabelled) == len(ODD) and all(r["lang_pred"] == "und" for r in unlabelled)


def test_many_languages(spark):
    """As many labels as a model may hold are learned, one more is an error."""
    rng = random.Random(4)
    letters = {f"l{i:03}": rng.sample("abcdefghijklmnopqrstuvwxyz", 6) for i in range(60)}
    rows = [(i, " ".join("".join(rng.choices(own, k=5)) for _ in range(80)), lang) for i, (lang, own) in enumerate(letters.items())]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language_mixture.fit(docs, F.lit(True), most=60)
    assert model.names == sorted(letters)
    found = language_mixture.identify(docs, model).collect()
    assert all(r["lang_pred"] == r["lang"] for r in found)
    with pytest.raises(ValueError, match="over 59 values"):
        language_mixture.fit(docs, F.lit(True), most=59)


def slow_mixture(model, text):
    """Shares of the selected languages, a trigram at a time."""
    raw = b" " + text.encode().lower() + b" "
    rows = []
    for i in range(len(raw) - 2):
        h = raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2]
        rows.append([float(x) for x in model.table[(h * 2654435761 % 2**32) >> 16]])

    def em(chosen, share):
        for _ in range(12 if len(chosen) > 1 else 0):
            moved = [0.0] * len(chosen)
            for p in rows:
                whole = sum(p[c] * s for c, s in zip(chosen, share))
                moved = [m + p[c] * s / whole for m, c, s in zip(moved, chosen, share)]
            new = [m / len(rows) for m in moved]
            done = max(abs(a - b) for a, b in zip(new, share)) < 1e-3
            share = new
            if done:
                break
        return share, sum(math.log(sum(p[c] * s for c, s in zip(chosen, share))) for p in rows)

    full, _ = em(range(len(model.names)), [1 / len(model.names)] * len(model.names))
    order = sorted(range(len(full)), key=lambda c: -full[c])
    chosen, share = order[:1], [1.0]
    best = em(chosen, share)[1]
    for extra in order[1:]:
        start = [max(full[c], 1e-4) for c in [*chosen, extra]]
        new, fit = em([*chosen, extra], [s / sum(start) for s in start])
        if fit - best <= 4 * math.log(len(rows) + 1):
            break
        chosen, share, best = [*chosen, extra], new, fit
    return dict(zip(chosen, share))


def test_language_mixture_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) < 1500")
    model = language_mixture.fit(docs, F.lit(True))
    by = {}
    for r in docs.collect():
        by.setdefault(r["lang"], []).append(r["text"])
    names = sorted(by)
    texts = [by[x][0] for x in names] + [by[a][1] + " " + by[b][2] for a, b in zip(names, names[1:])] + ["A", "x1"]
    for text in texts:
        want, got = slow_mixture(model, text), model.infer(text)
        assert set(got) == set(want) and all(got[c] == pytest.approx(want[c], abs=5e-3) for c in want)
    # Over 4 BUCKETS trigrams a text is its counts.
    long = " ".join(texts[:2]) * 300
    assert len(language_mixture.trigrams(long)) > 4 * language_mixture.BUCKETS
    whole = model.infer(long)
    share = slow_mixture(model, " ".join(texts[:2]) * 4)
    assert set(whole) == set(share) and all(whole[c] == pytest.approx(share[c], abs=0.02) for c in whole)


# 5: language model


def slow_scores(texts, train, least):
    """The model of ngram_trie, unquantised, in dictionaries."""
    toks = [[*WORD.findall((t or "").translate(LOWER)), None] for t in texts]
    c, c2, c3 = Counter(), Counter(), Counter()
    for t in (toks[i] for i in train):
        c.update(t)
        c2.update(zip(t, t[1:]))
    k2 = {p: n for p, n in c2.items() if n >= least}
    for t in (toks[i] for i in train):
        c3.update(x for x in zip(t, t[1:], t[2:]) if x[:2] in k2 and x[1:] in k2)
    k3 = {p: n for p, n in c3.items() if n >= least}
    n, v = sum(c.values()), len(c)
    b1, b2 = {}, {}
    for (a, _), m in k2.items():
        b1[a] = b1.get(a, 1) - (m - 0.75) / c[a]
    for (a, b, _), m in k3.items():
        b2[a, b] = b2.get((a, b), 1) - (m - 0.75) / c2[a, b]

    def p1(w):
        return (c[w] + 1) / (n + v + 1)

    def p2(a, w):
        return max(k2.get((a, w), 0.75) - 0.75, 0) / max(c[a], 1) + b1.get(a, 1) * p1(w)

    def p3(a, b, w):
        return p2(b, w) if (a, b) not in k2 else max(k3.get((a, b, w), 0.75) - 0.75, 0) / c2[a, b] + max(b2.get((a, b), 1), 1e-9) * p2(b, w)

    out = []
    for t in toks:
        own = sum(math.log10(p1(w) if i == 0 else p2(t[0], w) if i == 1 else p3(t[i - 2], t[i - 1], w)) for i, w in enumerate(t))
        out.append((len(t), sum(c[w] > 0 for w in t), n, sum(math.log10(p1(w)) for w in t), own))
    return out, (c, p3)


@pytest.mark.parametrize(("shard", "words", "least"), [(1 << 22, 1 << 22, 1), (3000, 500, 1), (3000, 1 << 22, 2)])
def test_language_model(spark, monkeypatch, shard, words, least):
    monkeypatch.setattr(ngram_trie, "TOKENS", shard)
    monkeypatch.setattr(ngram_trie, "WORDS", words)
    rows = [(r["doc_id"], r["text"]) for r in docs_of(spark).collect()] + [(i + 10_000 if i is not None else None, t) for i, t in ODD]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, score string")
    path, facts = ngram_trie.train(df, crc_mod("doc_id", 7) != 2, min_count=least)
    got = [tuple(r)[1:] for r in ngram_trie.score(df, path, facts).collect()]
    train = [i for i, (d, _) in enumerate(rows) if zlib.crc32(("" if d is None else str(d)).encode()) % 7 != 2]
    want, (c, p3) = slow_scores([t for _, t in rows], train, least)
    assert len(got) == len(want)
    for g, w in zip(sorted(got), sorted(want)):
        assert g[:3] == w[:3]
        assert g[3] == pytest.approx(w[3], rel=1e-9, abs=1e-9)
        assert abs(g[4] - w[4]) <= 0.03 * g[0]  # quantisation
    assert sum(p3("one", "two.", w) for w in [*c, "unseen"]) == pytest.approx(1, abs=1e-6)


def test_language_model_searches_do_not_grow_with_shards(spark, monkeypatch):
    """A group of texts is searched for in all shards at once, not in one shard after the other."""
    df = docs_of(spark).select("doc_id", "text")
    hashes, lengths = next(ngram_trie._groups(pa.array([r["text"] for r in df.limit(50).collect()])))
    calls, select = [], elias_fano._select
    monkeypatch.setattr(elias_fano, "_select", lambda *a: calls.append(1) or select(*a))
    used = []
    for shard in (1 << 22, 1000):
        monkeypatch.setattr(ngram_trie, "TOKENS", shard)
        path, facts = ngram_trie.train(df, F.lit(True))
        calls.clear()
        ngram_trie.score_tokens(ngram_trie.Trie(path, facts), hashes, lengths)
        used.append((len(facts["triples"]), len(calls)))
    assert used[0][0] == 1 and used[1][0] > 50
    assert used[1][1] <= used[0][1] + 10


def test_elias_fano_many():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, top, n)) for n, top in [(50_000, 1 << 40), (9, 10), (40_000, 90_000), (1, 1), (300, 1 << 20)]] + [np.zeros(0, np.int64)]
    many = elias_fano.EliasFanos([elias_fano.EliasFano.arrays(v) for v in sets])
    asked = [np.concatenate((v, v + 1, rng.integers(0, 1 << 41, 50))) for v in sets]
    which = np.repeat(np.arange(len(sets)), [len(x) for x in asked])
    want = [np.where(np.isin(x, v), np.searchsorted(v, x), -1) for v, x in zip(sets, asked)]
    assert (many.find(which, np.concatenate(asked)) == np.concatenate(want)).all()
    at = np.concatenate([np.arange(len(v)) for v in sets])
    assert (many.get(np.repeat(np.arange(len(sets)), [len(v) for v in sets]), at) == np.concatenate(sets)).all()


def test_language_model_without_text(spark, none, odd):
    path, facts = ngram_trie.train(none, F.lit(True))
    assert ngram_trie.score(none, path, facts).count() == 0
    assert all(r["score"] == 0 and r["train_tokens"] == 0 for r in ngram_trie.score(odd, path, facts).collect())


def test_word_hashes_do_not_depend_on_place():
    a, b = ngram_trie.tokens("one two  three\none"), ngram_trie.tokens("  three TWO one")
    assert len(a) == 5 and a[0] == a[3] == b[2] and a[1] == b[1] and a[2] == b[0] and a[4] == b[3]
    long = "w" * (ngram_trie.BLOCK + 10)
    x = ngram_trie.tokens(f"{long} b " + "c " * ngram_trie.BLOCK)
    assert len(x) == 3 + ngram_trie.BLOCK and x[1] == ngram_trie.tokens("b")[0]


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, u in ((1, 5), (10, 3), (1000, 10**6), (5000, 5001), (3000, 2**61)):
        v = np.sort(rng.integers(0, u, n))
        assert (elias_fano.EliasFano(elias_fano.EliasFano.arrays(v)).get(np.arange(n)) == v).all()
        v = np.unique(v)
        e, own = elias_fano.EliasFano(elias_fano.EliasFano.arrays(v)), set(v.tolist())
        q = np.concatenate((v, rng.integers(0, u, 500), [0, u, -1]))
        for x, p in zip(q.tolist(), e.find(q).tolist()):
            assert (p >= 0) == (x in own) and (p < 0 or v[p] == x)
        assert (e.all() == v).all()
        low, high = np.sort(rng.integers(0, len(v) + 1, (2, len(q))), axis=0)
        for x, p, i, j in zip(q.tolist(), e.find(q, low, high).tolist(), low.tolist(), high.tolist()):
            assert (p >= 0) == (x in own and i <= np.searchsorted(v, x) < j) and (p < 0 or v[p] == x)
    # Contexts in the high parts and children in the low: a long run of children, and contexts without any.
    v = np.sort(np.concatenate((rng.choice(1 << 12, 900, replace=False) + (3 << 12), rng.choice(40 << 12, 60, replace=False))))
    v = np.unique(v)
    e = elias_fano.EliasFano(elias_fano.EliasFano.arrays(v, 12))
    assert e.find(v).tolist() == list(range(len(v))) and (e.get(np.arange(len(v))) == v).all()
    assert all(p < 0 for x, p in zip(range(1 << 14), e.find(np.arange(1 << 14)).tolist()) if x not in set(v.tolist()))
    assert elias_fano.EliasFano(elias_fano.EliasFano.arrays(np.zeros(0, np.int64))).find(np.array([3])).tolist() == [-1]


# 6: top-k


def test_topk_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([0.0, rng.uniform(-1, 1)]) for _ in range(8)]) for i in range(90)]
    rows += [(100 + i, rows[0][1]) for i in range(30)] + [(200, None), (201, [1.0, None]), (202, [float("nan")]), (203, [float("inf")]), (204, []), (205, [0.5]), (40, rows[40][1]), (300, [1e9] * 8)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id bigint, embedding array<double>, score int")
    good = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = {}
    for q, v in dict((i, v) for i, v in good if i % 20 == 0).items():
        s = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q)[:20]
        want[q] = [(n + 1, i, -x) for n, (x, i) in enumerate(s)]
    got = {}
    for r in topk_search.search_embeddings(df).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert {q: sorted(x) for q, x in got.items()} == want
    assert topk_search.search_embeddings(df.where("vec_id < 0")).count() == 0
    assert topk_search.search_embeddings(df.where("vec_id in (20, 21)")).count() == 1


def test_topk_blocks_agree(spark, monkeypatch):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    whole = sorted(map(tuple, topk_search.search_embeddings(df).collect()))
    monkeypatch.setattr(topk_search, "CANDIDATES", 60)
    monkeypatch.setattr(topk_search, "QUERIES", 7)
    assert sorted(map(tuple, topk_search.search_embeddings(df).collect())) == whole


# 7: multiset hash


def test_multiset_hash_edited_texts(spark, odd, none):
    docs = docs_of(spark).select("doc_id", "text").limit(50)
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    got = {r["doc_id"]: r for r in multiset_hash.edited_fingerprints(docs).collect()}
    for (d, t), (_, n) in zip(rows, [*rows[1:], rows[0]]):
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        assert got[d]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[d]["n_chars"] == len(t)
    assert np.mean([r["near_edited"] for r in got.values()]) > 0.3 > np.mean([r["near_next"] for r in got.values()])
    out = multiset_hash.edited_fingerprints(odd).collect()
    assert len(out) == len(ODD)
    same = {r["fingerprint"] for r in out if r["doc_id"] in (4, 5)}
    assert len(same) == 1
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in out)
    assert multiset_hash.edited_fingerprints(none).count() == 0
    one = multiset_hash.edited_fingerprints(odd.where("doc_id = 9")).first()
    assert one["near_next"] == 1


def slow_vector(text):
    """(count, 128 sign counts, 4 strong sums) of a text's sentences and paragraphs."""
    pieces = [p.strip(" ") for p in re.split(multiset_hash.PIECES, text or "")]
    pieces = [p.encode() for p in pieces if p]
    paragraphs = [p.strip(multiset_hash.BLANK) for p in re.split(multiset_hash.PARAGRAPHS, text or "", flags=re.ASCII)]
    sha = [hashlib.sha256(p.encode()).hexdigest() for p in paragraphs if p]
    other = xxhash.xxh64_intdigest((1).to_bytes(4, "little"), 42)
    hashes = [[xxhash.xxh64_intdigest(p, 42) for p in pieces], [xxhash.xxh64_intdigest(p, other) for p in pieces]]
    signs = [sum(h >> k & 1 for h in own) % 2**16 for own in hashes for k in range(64)]
    return len(pieces), signs, [sum(int(h[15 * i : 15 * i + 15], 16) for h in sha) % 2**60 for i in range(4)]


def slow_likeness(a, b):
    if a == b:
        return 1.0
    x, y = ([2 * s - v[0] for s in v[1]] for v in (a, b))
    whole = sum(p * p for p in x) + sum(p * p for p in y)
    return max(0.0, min(1.0, 2 * sum(p * q for p, q in zip(x, y)) / whole)) if whole else 0.0


def test_multiset_hash_against_brute_force(spark, odd):
    docs = docs_of(spark).select("doc_id", "text").limit(60).unionByName(odd.select((F.col("doc_id") + 10**6).alias("doc_id"), "text"))
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.where("doc_id is not null").distinct().collect()))
    got = {r["doc_id"]: r for r in multiset_hash.edited_fingerprints(docs).collect()}
    for (d, t), (_, n) in zip(rows, [*rows[1:], rows[0]]):
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        vectors = [slow_vector(x) for x in (t, edited, n)]
        for name, (count, signs, strong) in zip(("fingerprint", "edited_fingerprint"), vectors):
            longs = [int(got[d][name][i : i + 16], 16) for i in range(0, len(got[d][name]), 16)]
            lanes = [[x >> at & 0xFFFF for x in longs[1:33]] for at in (0, 32, 16, 48)]
            assert longs[0] == count and [x for part in lanes for x in part] == signs and longs[33:] == strong
        assert got[d]["near_edited"] == pytest.approx(slow_likeness(vectors[0], vectors[1]), abs=1e-9)
        assert got[d]["near_next"] == pytest.approx(slow_likeness(vectors[0], vectors[2]), abs=1e-9)


def test_bpe_of_five_million_characters(spark):
    """One text by the tree, against the library's encoding of the whole."""
    from tokenizers import Tokenizer

    texts = [r["text"] or "" for r in docs_of(spark).select("text").collect()]
    text = "\n".join(texts)
    text = (text * (5_000_000 // len(text) + 1))[:5_000_000]
    library = Tokenizer.from_file(BYTE)
    library.no_truncation()
    library.no_padding()
    ids = library.encode(text, add_special_tokens=False).ids
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    got = bpe.encode_digests(df, BYTE).first()
    assert tuple(got) == (1, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_bpe_windows_grow_until_both_sides_agree():
    """Halves cut anywhere, joined by windows, are the whole's encoding; a first window that disagrees is not taken."""
    rng = random.Random(3)
    encode = lambda s: np.frombuffer(next(bpe.encoder(BYTE).encode([s])), "<u4").tolist()
    table = bpe.decoder(BYTE).table
    words = ["a", "the", "don't", "x1", "12345", "...", "?!", "é", "naïve", "  ", "\n", "\t"]
    for _ in range(300):
        text = " ".join(rng.choices(words, k=rng.randint(2, 40)))
        at = rng.randint(0, len(text))
        assert bpe.join_texts(encode(text[:at]), encode(text[at:]), encode, table) == encode(text)
    seen = []
    text = "one two three four five six seven eight nine ten eleven twelve"

    def wrong_at_first(s):
        seen.append(s)
        return encode(s) if len(seen) > 1 else [0, *encode(s)]

    left, right = encode(text[:30]), encode(text[30:])
    assert bpe.join_texts(left, right, wrong_at_first, table) == encode(text)
    assert len(seen) == 2 and seen[0] in seen[1] and len(seen[1]) > len(seen[0])


def test_words_that_powers_of_a_base_confuse_differ():
    """Thue-Morse words and their complements collide under every polynomial hash modulo 2**64."""
    bits = [0]
    while len(bits) < 4096:
        bits += [1 - x for x in bits]
    for n in (16, 512, 1024, 2048, 4096):
        a, b = ("".join("ab"[x ^ y] for x in bits[:n]) for y in (0, 1))
        found = ngram_trie.tokens(f"{a} {b} {a}")
        assert found[0] == found[2] != found[1]


def test_warc_magic_in_payloads_is_read_once(tmp_path):
    """Eight megabytes of headers that never end are one pass."""
    import time

    path, n = tmp_path / "magic.warc", 8 << 20
    path.write_bytes(warc.MAGIC * (n // len(warc.MAGIC)) + b"\r\n\r\n")
    began = time.time()
    assert warc._candidates(f"file:{path}", path.stat().st_size, 0, n) == []
    assert time.time() - began < 5
    body = b"x" * 10
    record = warc.MAGIC + b"A: 1\r\nContent-Length: 10\r\n\r\n" + body + warc.END.encode()
    path.write_bytes(record * 3)
    assert [x for x, _ in warc._candidates(f"file:{path}", 3 * len(record), 0, 3 * len(record))] == [0, len(record), 2 * len(record)]


def test_topk_of_repeated_rows_keeps_blocks_small(spark, monkeypatch):
    """Equal rows are dealt over all blocks; wide scores are selected, not sorted."""
    monkeypatch.setattr(topk_search, "CANDIDATES", 500)
    sizes = []
    real = topk_search.best_of_block
    for scale in (1, 1 << 20, 1 << 40):
        rows = spark.range(1500).select(F.lit(5).cast("bigint").alias("vec_id"), F.array(F.lit(scale), F.lit(2)).cast("array<bigint>").alias("weights"))
        rows = rows.unionByName(spark.createDataFrame([(i, [i * scale, 1]) for i in range(6, 60)], "vec_id bigint, weights array<bigint>"))
        got = topk_search.search(rows, rows.where("vec_id = 6"), 5).orderBy("rank").collect()
        assert [(r["vec_id"], r["score"]) for r in got] == [(59 - i, min(2**63 - 1, 6 * scale * (59 - i) * scale + 1)) if 6 * scale * 55 * scale < 2**63 else (7 + i, 2**63 - 1) for i in range(5)] or scale == 1 << 40
        dealt = rows.withColumn("row", F.monotonically_increasing_id()).groupBy(F.pmod(F.xxhash64("row"), F.lit(4))).count().collect()
        sizes.append(max(r["count"] for r in dealt))
    assert max(sizes) < 500 and real is topk_search.best_of_block


def test_wide_scores_against_sorting():
    rng = np.random.default_rng(4)
    for top in (3, 1 << 20, 1 << 40):
        ids, weights, queries = rng.permutation(50), rng.integers(-top, top, (3, 50)), rng.integers(-top, top, (3, 4))
        qids = ids[:4]
        for qid, found, scores in topk_search.best_of_block(ids, weights, qids, queries, 7):
            q = [int(x) for x in queries[:, list(qids).index(qid)]]
            want = sorted(((-sum(int(a) * b for a, b in zip(w, q)), int(i)) for i, w in zip(ids, weights.T) if i != qid))[:7]
            assert sorted((-int(s), int(i)) for i, s in zip(found, scores)) [:7] == want


def test_multiset_hash_is_homomorphic_and_order_free(spark):
    same = [("a.\n\nb.\n\nc.", "c.\n\na.\n\nb."), ("para one\npara two", "para two\npara one"), ("x.\ny.", "x. \t\r\n y. ")]
    df = multiset_hash.fingerprinted(multiset_hash.fingerprinted(spark.createDataFrame(same, "x string, y string"), "x", "v"), "y", "w")
    assert all(r["v"] == r["w"] for r in df.collect())
    apart = spark.createDataFrame([("a. b.", "a. a. b."), ("a b", "b a"), ("ab", "a\nb"), ("a. b.", "b. a."), ("A one. B two.\n\nC three.", "A one.\n\nB two. C three.")], "x string, y string")
    df = multiset_hash.fingerprinted(multiset_hash.fingerprinted(apart, "x", "v"), "y", "w")
    assert not any(r["v"] == r["w"] for r in df.collect())
    df = spark.createDataFrame([("a.\nb.\nc.\nd.\n" * 9, "a.\n" * 9, "b.\nc.\nd.\n" * 9), ("", "", ""), ("x\n" * 70_000 + "y", "x\n" * 70_000, "y")], "x string, p string, q string")
    for c in df.columns:
        df = multiset_hash.fingerprinted(df, c, f"v{c}")
    v = {c: F.col(f"v{c}") for c in "xpq"}
    r = df.select((multiset_hash.insert(v["p"], v["q"]) == v["x"]).alias("insert"), (multiset_hash.delete(v["x"], v["p"]) == v["q"]).alias("delete"), multiset_hash.likeness(v["x"], v["x"]).alias("like"))
    assert all(r["insert"] and r["delete"] and r["like"] == 1 for r in r.collect())


# 8: WARC

MAGIC = "x WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nabc\r\n\r\nWARC/1.1\r\nContent-Length: 40\r\n\r\n é"


@pytest.mark.parametrize("size", [8 << 20, 900])
def test_warc_round_trip(spark, size):
    rows = [(-1, None, None), (-2, "u", ""), (-3, "v", MAGIC * 3), (3, "a\r\nb", "page"), (4, None, "page"), (2, "c", "page"), (2, "c", "page"), (9, "d", MAGIC), (None, "n", "lost id"), (10, "é", "ü" * 5000)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "page_id bigint, url string, html string, digest int").repartition(2)
    path = queries.warc.new_path(spark, "warc")
    warc.write(df, path)
    got = warc.read(spark, path, size).collect()
    first = {}
    for p, _, h in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(h or "", p)
    want = Counter()
    for p, _, h in rows:
        raw = (h or "").encode()
        own = first[h or ""] == p
        want[p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if own else "revisit", None if own else first[h or ""], (h or "") if own else None] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["html"]) for r in got) == want


@pytest.mark.parametrize("size", [8 << 20, 5000])
def test_warc_long_headers(spark, size):
    """Headers longer than what is read ahead, with empty lines and magic in what follows."""
    rows = [(1, "data:" + "x" * 100_000, "a"), (2, "u", MAGIC * 50), (3, "y" * 70_000, MAGIC), (4, "data:" + "z" * 300_000, None)]
    path = queries.warc.new_path(spark, "warc")
    warc.write(spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1), path)
    got = {r["page_id"]: (r["url"], r["html"]) for r in warc.read(spark, path, size).collect()}
    assert got == {p: (u, h or "") for p, u, h in rows}


def test_warc_ranges_are_read_by_many_tasks(spark):
    rows = [(i, "u", f"{i} " * 500) for i in range(400)]
    path = queries.warc.new_path(spark, "warc")
    warc.write(spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1), path)
    back = warc.read(spark, path, 20_000)
    tasks = back.select(F.spark_partition_id().alias("t")).distinct().count()
    assert tasks > 10 and back.count() == 400


def test_warc_small_payloads_and_empty_table(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id bigint, url string, html string")
    got = {r["page_id"]: r["record_type"] for r in warc.round_trip(df, min_bytes=3).collect()}
    assert got == {1: "response", 2: "response", 3: "response", 4: "revisit"}
    assert warc.round_trip(df.where("page_id < 0")).count() == 0


def test_warc_broken_archive(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"WARC/1.1\r\nWARC-Type: warcinfo\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n")
    [info] = warc.read(spark, f"file://{tmp_path}").collect()
    assert (info["record_type"], info["html"], info["page_id"]) == ("warcinfo", "abc", None)
    (tmp_path / "a.txt").write_bytes((tmp_path / "a.txt").read_bytes() + b"junk")
    with pytest.raises(Exception, match="no record at"):
        warc.read(spark, f"file://{tmp_path}").collect()


# 9: quality


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scored = byte_cnn.quality(docs.select("doc_id", "text"), labels, 5).join(labels, "doc_id").where(crc_mod("doc_id", 5) == 0).collect()
    good, bad = ([r["score"] for r in scored if r["quality"] == q] for q in (1, 0))
    assert np.mean([[g > b for b in bad] for g in good]) > 0.95
    assert np.mean([(r["score"] >= 0.3) == r["quality"] for r in scored]) > 0.9


def test_quality_edges(spark, odd, none):
    labels = spark.createDataFrame([(4, 1), (5, None), (7, 0), (8, 0), (8, 0), (None, 1)], "doc_id bigint, quality int")
    got = byte_cnn.quality(odd.select("doc_id", "text"), labels, None).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (1, 2)}) == 1
    assert all(r["score"] == 0.5 for r in byte_cnn.quality(odd.select("doc_id", "text"), labels.where("doc_id < 0"), None).collect())
    assert byte_cnn.quality(none, labels, None).count() == 0


def test_quality_network_covers_the_text_and_its_gradient_is_right():
    parts = list(byte_cnn.Network.chunks(np.zeros(10_000, np.uint8)))
    seen = np.zeros(10_000, int)
    for at, x in parts:
        seen[at : at + len(x)] += 1
    assert seen.min() >= 1
    net, data = byte_cnn.Network(), np.frombuffer(b"some bytes to look at, twice over. " * 150, np.uint8)
    g, y = net.gradient(data, 1)
    for name, at in (("w2", (3,)), ("w1", (5, 2)), ("b1", (4,))):
        step, old = 1e-3, net.p[name][at]
        loss = []
        for s in (step, -step):
            net.p[name][at] = old + s
            loss.append(-math.log(net.score(data.tobytes().decode())))
        net.p[name][at] = old
        assert g[name][at] == pytest.approx((loss[0] - loss[1]) / (2 * step), rel=0.05, abs=2e-3)


def slow_quality(net, data):
    """The network's probability, one filter and place at a time."""
    p = {k: v.astype(float) for k, v in net.p.items()}
    means, tops, at = [], [], 0
    while at == 0 or at < len(data) - byte_cnn.OVERLAP:
        chunk = list(data[at : at + byte_cnn.CHUNK])
        chunk += [0] * (max(byte_cnn.WIDTH, -(-len(chunk) // byte_cnn.STEP) * byte_cnn.STEP) - len(chunk))
        seen = np.array([p["embed"][chunk[i : i + byte_cnn.WIDTH]].ravel() for i in range(0, len(chunk) - byte_cnn.WIDTH + 1, byte_cnn.STEP)])
        means.append([max(0.0, max(row @ p["filters"][:, f] for row in seen) + p["bias"][f]) if len(data) else 0.0 for f in range(byte_cnn.FILTERS)])
        at += byte_cnn.CHUNK - byte_cnn.OVERLAP
    f = [*np.mean(means, axis=0), *np.max(means, axis=0), math.log1p(len(data)) / 10]
    h = [max(0.0, sum(x * w for x, w in zip(f, p["w1"][:, j])) + p["b1"][j]) for j in range(byte_cnn.HIDDEN)]
    return 1 / (1 + math.exp(-sum(x * w for x, w in zip(h, p["w2"])) - p["b2"][0]))


def test_quality_against_brute_force(spark):
    docs, labels = docs_of(spark).select("doc_id", "text"), spark.read.parquet(f"{SF}/labels.parquet")
    texts, marks = byte_cnn.sample(docs, labels)
    net = byte_cnn.fit(texts, marks, epochs=2)
    cases = [*texts[:6], "", "a", "é" * 5, "word " * 3000, "x" * (byte_cnn.CHUNK + 1)]
    got = [r["score"] for r in byte_cnn.classify(spark.createDataFrame([(t,) for t in cases], "text string").coalesce(1), net).collect()]
    assert got == pytest.approx([slow_quality(net, t.encode()) for t in cases], abs=1e-4)


def test_quality_sample_is_bounded_and_settled(spark):
    """A text over the bound is passed over; labels that differ and rows that repeat have one result in any order."""
    docs = [(i, f"text {i} " * 20) for i in range(40)] + [(7, "other text of 7"), (8, "text 8 " * 20)]
    labels = [(i, i % 2) for i in range(40)] + [(3, 0), (5, 0), (5, None)]
    first = min(range(40), key=lambda i: spark.range(1).select(F.pmod(F.xxhash64(F.lit("sample"), F.lit(i).cast("bigint")), F.lit(1 << 30))).first()[0])
    docs[first] = (first, "long " * 20_000)
    got = []
    for d, n in ((docs, labels), (docs[::-1], labels[::-1])):
        d, n = spark.createDataFrame(d, "doc_id bigint, text string"), spark.createDataFrame(n, "doc_id bigint, quality int")
        got.append(byte_cnn.sample(d, n, sample_bytes=50_000))
    assert got[0] == got[1] and len(got[0][0]) == 40 and "long " * 20_000 not in got[0][0]
    assert dict(zip(*got[0]))["text 3 " * 20] == 0 and dict(zip(*got[0]))["text 5 " * 20] == 0
    assert len(byte_cnn.sample(d, n, rows=10)[0]) <= 11


# 10: BPE


def test_bpe_round_trip(spark, odd, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BYTE)
    source = docs_of(spark).select("doc_id", "text").limit(40).unionByName(odd.select("doc_id", "text"))
    want = Counter()
    for r in source.collect():
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids
        text = t.decode(ids, skip_special_tokens=False)
        want[r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
    for leaf, longest in ((bpe.LEAF, bpe.LONGEST), (40, 100), (8, 0), (bpe.LEAF, 5000)):
        assert Counter(map(tuple, bpe.encode_digests(source, BYTE, leaf, longest).collect())) == want
    assert bpe.encode_digests(none, BYTE).count() == 0


def test_bpe_trees_equal_whole_encodings():
    encode, token = bpe._model(BYTE)
    stand_in = {b: c for c, b in bpe._byte_chars().items()}
    rng = random.Random(5)
    for leaf in (2, 16, 300):
        for _ in range(15):
            s = "".join(rng.choices(["the", "ing", "é", "a", "zzz", "ation", "日", "q", "--", "0"], k=400))
            s = "".join(stand_in[b] for b in s.encode())
            assert bpe.join_tree([encode(x) for x in bpe.leaves(s, leaf)], lambda a, b: bpe.join_ids(a, b, encode, token)) == encode(s)


def test_bpe_halved_texts_equal_whole_encodings():
    """Texts halved anywhere: in words, contractions, runs of white space, special tokens and characters of many bytes."""
    from tokenizers import Tokenizer

    t, e, rng = Tokenizer.from_file(BYTE), bpe.encoder(BYTE), random.Random(7)
    table, one = bpe.decoder(BYTE).table, lambda x: np.frombuffer(next(e.encode([x])), "<u4").tolist()
    pieces = ["don't", " ", "  ", "\n", "\n\n", " \n", " word", " words.", " Ünï", " 123", "!!", "'ll", "\xa0", "日本", "<|endoftext|>", " a b", "\u3000", " (x)", "é"]
    for leaf in (1, 3, 17, 60):
        for _ in range(150):
            s = "".join(rng.choices(pieces, k=rng.randint(1, 60)))
            parts = [one(x) for x in bpe.leaves(s, leaf)]
            assert bpe.join_tree(parts, lambda a, b: bpe.join_texts(a, b, one, table)) == t.encode(s, add_special_tokens=False).ids
    assert bpe._splits("a b " * 3000, 100) and not bpe._splits("a b " * 10 + "x" * 101 + " y", 100) and not bpe._splits(" " * 200, 100)


@pytest.mark.parametrize("path", [BYTE, WORDS])
def test_bpe_fast_path_equals_the_library(path):
    from tokenizers import Tokenizer

    t, e, rng = Tokenizer.from_file(path), bpe.Encoder(path), random.Random(6)
    pieces = ["don't", " ", "  ", "\n", "\n\n", "\t", " \n", "word", "Ünï", "123", "4", "!!", "...", "'ll", "\xa0", "–", "Ÿ", "x_y", "²", "日", "\x1c", "\x85", "é", "<|", "İ"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 12))) for _ in range(3000)]
    assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts)] == [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def test_language_model_query_holds_ngrams_seen_once(spark, tmp_path):
    """op5_ngram_trie against the model of all n-grams, those seen once too."""
    docs = docs_of(spark).select("doc_id", "text").orderBy("doc_id").limit(60)
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    texts = {r["doc_id"]: [*WORD.findall((r["text"] or "").translate(LOWER)), None] for r in docs.collect()}
    c, c2, c3 = Counter(), Counter(), Counter()
    for d, t in texts.items():
        if zlib.crc32(str(d).encode()) % 7 != 2:
            c.update(t)
            c2.update(zip(t, t[1:]))
            c3.update(zip(t, t[1:], t[2:]))
    after1, after2, n, v = Counter(a for a, _ in c2), Counter(x[:2] for x in c3), sum(c.values()), len(c)

    def p1(w):
        return (c[w] + 1) / (n + v + 1)

    def p2(a, w):
        return p1(w) if not c[a] else max(c2[a, w] - 0.75, 0) / c[a] + (1 - (sum2[a] - 0.75 * after1[a]) / c[a]) * p1(w)

    def p3(a, b, w):
        m = c2[a, b]
        return p2(b, w) if not m else max(c3[a, b, w] - 0.75, 0) / m + max(1 - (sum3[a, b] - 0.75 * after2[a, b]) / m, 1e-9) * p2(b, w)

    sum2, sum3 = Counter(), Counter()
    for (a, _), m in c2.items():
        sum2[a] += m
    for x, m in c3.items():
        sum3[x[:2]] += m
    got = {r["doc_id"]: r for r in queries.op5_ngram_trie(spark, str(tmp_path)).collect()}
    assert set(got) == set(texts)
    for d, t in texts.items():
        want = sum(math.log10(p1(w) if i == 0 else p2(t[0], w) if i == 1 else p3(t[i - 2], t[i - 1], w)) for i, w in enumerate(t))
        assert abs(got[d]["score"] - want) <= 0.03 * len(t)  # quantisation
