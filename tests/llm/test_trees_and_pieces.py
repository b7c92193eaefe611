"""Merkle manifest, SentencePiece encoding and Patricia trie against brute force, SQL and the library."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from presage.llm import merkle, patricia, piece_bpe, queries

SF = "/root/testdata/sf0.001"
MODEL = queries.tokenizer_path("piece_bpe_32k.model")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# 11: Merkle manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def expected_manifest(rows):
    """Trees built whole, from (doc_id, source, lang, n_chars, text)."""

    def leaf(r):
        return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))

    def tree(nodes):
        rows = [nodes]
        while len(rows[-1]) > 1:
            rows.append([sha(*rows[-1][i : i + 3]) for i in range(0, len(rows[-1]), 3)])
        return rows

    def path(tree, i):
        for row in tree[:-1]:
            start = i // 3 * 3
            yield i - start, [x for j, x in enumerate(row[start : start + 3], start) if j != i]
            i //= 3

    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s in names}
    trees = {s: tree([leaf(r) for r in own[s]]) for s in names}
    top = tree([trees[s][-1][0] for s in names])
    for k, s in enumerate(names):
        for i, r in enumerate(own[s]):
            steps = [*path(trees[s], i), *path(top, k)]
            text = r[4]
            if text is not None and zlib.crc32(b"" if r[0] is None else str(r[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            up = leaf((*r[:4], text))
            for place, others in steps:
                up = sha(*others[:place], up, *others[place:])
            proof = sha(*(x for _, others in steps for x in others))
            yield r[0], leaf(r), trees[s][-1][0], top[-1][0], proof, up, up == top[-1][0]


@pytest.mark.parametrize("height", [1, 2, 6])
def test_manifest_of_documents(spark, height):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text")
    got = rows_of(merkle.document_manifest(docs, height))
    assert got == sorted(expected_manifest([tuple(r) for r in docs.collect()]), key=repr)
    assert {r[6] for r in got} == {True, False}


def test_manifest_of_odd_rows(spark):
    """Nulls in every column, repeated rows, no line ends to delete, a long text, a column named like an own one; none; one."""
    rows = [(None, None, None, None, None), (None, None, "x", 1, "a\nb"), (2, "s", None, None, "é\n"), (2, "s", None, None, "é\n"), (5, "", "l", 3, ""), (6, "long", "l", 0, "x\n" * 400_000)]
    rows += [(i, "t", "l", 1, "\n" * i) for i in range(29)] + [(77, "same", "l", 1, "\n")] * 40
    kind = "doc_id bigint, source string, lang string, n_chars bigint, text string, pos string, total double"
    df = spark.createDataFrame([(*r, "x", 0.5) for r in rows], kind)
    for height in (1, 6):
        assert rows_of(merkle.document_manifest(df, height)) == sorted(expected_manifest(rows), key=repr)
    assert merkle.document_manifest(df.where("false")).count() == 0
    assert rows_of(merkle.document_manifest(df.where("doc_id = 5 and source = ''"))) == [*expected_manifest([rows[4]])]


@pytest.mark.parametrize("size", [1, 2, 3, 4, 9, 10, 26, 27, 28, 80, 81])
def test_traversal_is_on_time_and_small(size):
    """Stacks are done when they are needed, one step a leaf and level; what is held grows with the levels."""
    leaves = [hashlib.sha256(bytes([i])).digest() for i in range(size)]
    height = merkle.levels(size)
    walk = merkle.Traversal(leaves.__getitem__, size, height)
    top = merkle.root(leaves.__getitem__, size, height)
    for i in range(size):
        assert merkle.fold(leaves[i], i, walk.path()) == top
        held = sum(x is not None for run in walk.runs for x in run) + sum(len(s.stack) for two in walk.ahead for s in two)
        assert held <= 3 * height + 2 * height * (height + 2)
        if i + 1 < size:
            due = [h for h in range(height) if (i + 1) % 3 ** (h + 1) == 0]
            before = [[(len(s.stack), s.next) for s in two] for two in walk.ahead]
            steps = [sum(not s.done for s in walk.ahead[h]) for h in due]
            # All but the step taken while going on are behind us.
            assert all(n <= 1 for n in steps), (i, before)
            walk.advance()


# 12: SentencePiece


@pytest.fixture(scope="module")
def made():
    return piece_bpe.Pieces(MODEL)


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def check_text(made, library, text):
    ids, back = made.encode(text)
    want = library.encode(text or "", add_bos=True, add_eos=True)
    assert np.frombuffer(ids, "<u4").tolist() == want, repr(text[:80])
    assert back.decode() == library.decode(want), repr(text[:80])


ODD_TEXTS = [
    "", " ", "a", " a", "▁a", "a\n\nb", "<s>x</s>", "<0x41>", "Hello  world", "漢字🎉", "\0a", "a　b", "ﬁ Ⅳ é é", "﻿a", "a\r\nb\tc", "�", "\xa0x", "a  ", "▁▁▁", "   ▁ ▁",
    "\n a", "x" * 3000, "ab" * 2000, " " * 1000, "‍", "🎉" * 50, "word.com, it's; so?!... no.", "the" * 500,
]


def test_pieces_of_odd_texts(made, library):
    for text in ODD_TEXTS:
        check_text(made, library, text)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.sampled_from([" ", "  ", "▁", "\n", "th", "ing", "e", "s", ".", ",", "1", "é", "漢", "🎉", "<s>"]), st.text(max_size=4)), max_size=20))
def test_pieces_of_any_text(made, library, parts):
    text = "".join(parts).encode("utf-8", "ignore").decode()
    check_text(made, library, text)


def test_pieces_of_joined_tokens(made, library):
    rng = random.Random(5)
    names = list(made.texts.values())
    for _ in range(3000):
        check_text(made, library, "".join(rng.choices(names, k=rng.randint(1, 8))))


def test_pairs_fit_as_merging_says(made):
    """The walk along the border against merging the pair's characters."""
    rng = random.Random(6)
    ids = list(made.texts)
    known = {t: i for i, t in made.texts.items()}
    for _ in range(4000):
        left = rng.choice(ids)
        tail = made.texts[left]
        right = rng.choice(ids) if rng.random() < 0.5 else known.get(tail[-rng.randint(1, len(tail)) :], rng.choice(ids))
        assert made.compatible(left, right) == (made.merge(tail + made.texts[right]) == [tail, made.texts[right]])


def test_word_memo_turns_over(library, monkeypatch):
    monkeypatch.setattr(piece_bpe, "MEMO", 3)
    small = piece_bpe.Pieces(MODEL)
    for text in ["one two three four five one two", "six one two seven", "one eight nine ten two"]:
        check_text(small, library, text)


def test_sentencepiece_query(spark, library):
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op12_sentencepiece(spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert got == {r["doc_id"]: digests(library, r["text"]) for r in rows}


def digests(library, text):
    ids = library.encode(text or "", add_bos=True, add_eos=True)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_sentencepiece_of_odd_rows(spark, library):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "no id"), (4, "long " * 200_000), (5, "unsplit" * 100_000)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id bigint, text string, n_tokens int, ids string")
    got = rows_of(piece_bpe.encode_digests(df, MODEL))
    assert got == sorted(((i, *digests(library, t)) for i, t in rows), key=repr)
    assert piece_bpe.encode_digests(df.where("false"), MODEL).count() == 0


# 13: Patricia trie


def expected_nodes(rows, again=True):
    """Every prefix by itself, from (conv_id, turn, role, text)."""
    by = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            by.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in by.items()}
    heads = {c: zlib.crc32(str(c).encode()) % 6 if again else 0 for c in own}
    convs = {c: own.get(c - c % 100, [])[: heads[c]] + turns[heads[c] :] for c, turns in own.items()}
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for k in members:
        if k:
            children.setdefault(k[:-1], []).append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in children[k]) if k in children else 1
        saved[k] = sum(saved[x] for x in children.get(k, [])) + ((len(members[k]) - 1) * len(k[-1][1]) if k else 0)
    for k, m in members.items():
        ends = hashlib.sha256(",".join(str(c) for c in sorted(m) if len(convs[c]) == len(k)).encode()).hexdigest()
        yield min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(children.get(k, [])), leaves[k], saved[k], ends


TURNS = "conv_id bigint, turn bigint, role string, text string"


def nodes(df, again=True):
    paths = patricia.turn_paths(df)
    return rows_of(patricia.prefix_nodes(patricia.rebuilt(paths) if again else paths))


def test_patricia_of_conversations(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text")
    assert nodes(df) == sorted(expected_nodes([tuple(r) for r in df.collect()]), key=repr)


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("chunk", [3, 4096])
def test_patricia_of_few_turns(spark, monkeypatch, seed, chunk):
    """Few different turns: deep sharing, copies, ends on inner nodes, ranges that cut nodes."""
    monkeypatch.setattr(patricia, "CHUNK", chunk)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rng = random.Random(seed)
        rows = [(c, t, rng.choice(["user", None]), rng.choice(["a", "bb", None, "é日"])) for c in range(150) for t in range(rng.randint(1, 9))]
        assert nodes(spark.createDataFrame(rows, TURNS), seed % 2 == 0) == sorted(expected_nodes(rows, seed % 2 == 0), key=repr)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_patricia_of_odd_rows(spark):
    rows = [(None, 1, "u", "x"), (3, None, "u", "x"), (3, None, "u", "x"), (3, 1, "u", "y"), (3, 1, "a", "y"), (103, 0, None, None), (7, 0, "u", "long" * 10_000), (8, 0, "u", "a" * 100), (8, 0, "u", "b")]
    rows += [(1000, t, "u", str(t)) for t in range(500)] + [(2000, t, "u", str(t)) for t in range(499)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], TURNS + ", path string, n int")
    assert nodes(df) == sorted(expected_nodes(rows), key=repr)
    assert nodes(df, False) == sorted(expected_nodes(rows, False), key=repr)
    assert nodes(df.where("false")) == []


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op13_patricia_trie"])
def test_sql_says_the_same(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    found = con.execute(queries.ORACLE_SQL[name])
    assert [d[0] for d in found.description] == df.columns
    assert rows_of(df) == sorted(found.fetchall(), key=repr)
