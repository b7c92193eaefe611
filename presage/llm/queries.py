"""The thin opN queries over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presage.llm import bpe, byte_cnn, language_mixture, merkle, multiset_hash, ngram_trie, packing, patricia, piece_bpe, prefix_tree, simhash, topk_search, warc
from presage.llm.common import crc_mod, table
from presage.llm.merkle_sql import MERKLE_SQL
from presage.llm.patricia_sql import PATRICIA_SQL


def op1_prefix_tree_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", control), (-7, 1, "assistant", control)], "conv_id bigint, turn bigint, role string, text string")
    return prefix_tree.read_back(prefix_tree.format_conversations(rows.unionByName(extra), tokenizer=tokenizer_path("byte_bpe_50k.json")))


def op2_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"), end_id=0, capacity=2048)


def op4_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language_mixture.languages(docs, held_out=4, remainder=2)
    return found.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op5_ngram_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path, facts = ngram_trie.train(docs, crc_mod("doc_id", 7) != 2, min_count=1)
    found = ngram_trie.score(docs, path, facts)
    return found.select("doc_id", (crc_mod("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.search_embeddings(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op7_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset_hash.edited_fingerprints(table(spark, sf_dir, "documents"))


def op8_warc_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.round_trip(table(spark, sf_dir, "pages"), min_bytes=0)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_byte_cnn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = byte_cnn.quality(docs, table(spark, sf_dir, "labels"), held_out=5)
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.document_manifest(table(spark, sf_dir, "documents"))


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.encode_digests(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op13_patricia_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = patricia.turn_paths(table(spark, sf_dir, "conversations"))
    return patricia.prefix_nodes(patricia.rebuilt(paths))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_prefix_tree_chat": op1_prefix_tree_chat,
    "op2_simhash_neardup": op2_simhash_neardup,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_language_mixture": op4_language_mixture,
    "op5_ngram_trie": op5_ngram_trie,
    "op6_exact_topk": op6_exact_topk,
    "op7_multiset_hash": op7_multiset_hash,
    "op8_warc_chain": op8_warc_chain,
    "op9_byte_cnn_quality": op9_byte_cnn_quality,
    "op10_bpe_round_trip": op10_bpe_round_trip,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_sentencepiece": op12_sentencepiece,
    "op13_patricia_trie": op13_patricia_trie,
}

_TOPK_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as w
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), scored as (
  select q.vec_id as query_id, c.vec_id as vec_id,
         cast(list_sum(list_transform(range(1, len(q.w) + 1), lambda i: q.w[i] * c.w[i])) as bigint) as score
  from v q join v c on q.vec_id % 20 = 0 and c.vec_id <> q.vec_id
), ranked as (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as r from scored
)
select query_id, cast(r as int) as rank, vec_id, score from ranked where r <= 20
"""

# Base32 of a digest: 40 bits of the hex text at a time, 5 bits to a character.
_WARC_SQL = """
with p as (select page_id, coalesce(html, '') as h from pages),
d as (select page_id, h, sha1(h) as hex, strlen(h) as n, min(page_id) over (partition by h) as first from p)
select page_id, cast(n as bigint) as payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      cast(((cast(concat('0x', substr(hex, 1 + 10 * (i // 8), 10)) as bigint) >> (35 - 5 * (i % 8))) & 31) + 1 as bigint), 1)),
    'string_agg', '') as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type,
  case when page_id = first then null else first end as refers_to
from d
"""

ORACLE_SQL: dict[str, str] = {"op6_exact_topk": _TOPK_SQL, "op8_warc_chain": _WARC_SQL, "op11_merkle_manifest": MERKLE_SQL, "op13_patricia_trie": PATRICIA_SQL}
