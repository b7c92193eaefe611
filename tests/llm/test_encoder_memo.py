"""The encoder's memo: generations give the same ids with fewer misses, and a task leaves none behind."""

import random

import pyarrow as pa
import public_tokenizers

from presage.llm import bpe, packing

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", None, "\x00a\x01 b", "don't I'LL x's 12ab é'é ¼ ² ª", "a b\x85c", "ÀÉ ŸŠ ŉ 'S's", "<|x|> a", "123 4", "a\u200bb", "\x1f x\x1c end."]


def test_generations_keep_the_words_in_use(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 200)
    rng = random.Random(2)
    texts = ODD + [" ".join([*(f"common{i}" for i in range(50)), *(f"rare{rng.randrange(10**9)}," for _ in range(30))]) for _ in range(60)]
    own = bpe.Encoder(PATH)
    made, make = [], own.memo.make
    own.memo.make = lambda x: made.append(x) or make(x)
    got = list(own.encode(texts))
    assert got == [pa.array(own.tokenizer.encode(t or "", add_special_tokens=False).ids, pa.uint32()).to_numpy(zero_copy_only=False).tobytes() for t in texts]
    assert made.count("common") <= 1  # anew after each clearing before
    assert len(own.memo) + len(own.memo.old) < 800


def test_a_task_leaves_no_words_behind(spark):
    docs = spark.createDataFrame([(1, "some words, and others")], "doc_id bigint, text string").coalesce(1)
    assert packing.tokenized_pieces(docs, PATH).count() == 1
    left = spark.range(1).coalesce(1).mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([pa.array([len(bpe.encoder(PATH).memo)], pa.int64())], ["n"]) for b in bs), "n bigint")
    assert left.first()["n"] == 0
