"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldledger.llm import (
    jaccard_join,
    license_scan,
    mixing,
    nn_descent,
    prefix_trie,
    quality,
    sentencepiece_codec,
    spelling,
    suffix_dedup,
    token_counts,
    token_store,
    topk,
    toxicity,
)
from fieldledger.llm.common import table
from fieldledger.llm.oracles import OP4_SQL, OP11_SQL, OP13_SQL
from fieldledger.session import fresh_dir

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = public_tokenizers.path("piece_bpe_32k.model")
    # Every text's words are compared with the SentencePiece library where they are encoded.
    coded = sentencepiece_codec.encoded(docs, model, ["n_pieces", "ids_crc32", "decoded"])
    return coded.select("doc_id", "n_pieces", "ids_crc32", F.col("decoded").eqNullSafe(F.col("text")).alias("restored"))


def op3_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    plan = mixing.plan(docs)
    # What the shards hold of each document; passes over a document count up from 0.
    taken = mixing.draw(docs, plan).groupBy("key").agg((F.max("pass") + 1).alias("times"))
    return mixing.weighed(docs, plan).join(taken, "key", "left").select(
        "row.doc_id", "size", "source_size", "target", (F.col("size") * F.coalesce("times", F.lit(0))).alias("taken")
    )


def op4_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.similar(table(spark, folder, "documents"))


def op5_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    net = quality.fit(docs, table(spark, folder, "labels"))
    return quality.scores(docs, net).select(
        "doc_id",
        quality.held_out("doc_id").alias("held_out"),
        "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


def op6_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cut = suffix_dedup.cut_out(table(spark, folder, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    return topk.search(rows, rows.where("vec_id % 50 = 0"))


OP7_SQL = """
with usable as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), scored as (
  select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.v::double[], c.v::double[]) as bigint) as score
  from usable q join usable c on c.vec_id <> q.vec_id
  where q.vec_id % 50 = 0
)
select query_id, cast(row_number() over w as integer) as rank, vec_id, score
from scored
window w as (partition by query_id order by score desc, vec_id)
qualify row_number() over w <= 5
"""


def op8_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.scan(table(spark, folder, "documents"))


def op9_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = nn_descent.near_duplicates(table(spark, folder, "embeddings"))
    return found.withColumn("kept", F.col("vec_id") == F.col("component_id"))


OP9_SQL = """
with recursive unit as (
  select vec_id, list_transform(embedding, lambda x: cast(x as double)) as v
  from embeddings
  where embedding is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0
), links as (
  select a.vec_id as a, b.vec_id as b
  from unit a join unit b on a.vec_id <> b.vec_id
  where list_cosine_similarity(a.v, b.v) >= 0.95
), reached as (
  select vec_id as a, vec_id as b from embeddings
  union
  select r.a, l.b from reached r join links l on l.a = r.b
), counted as (
  select a, count(*) as n from links group by a
), least as (
  select a, min(b) as component_id from reached group by a
)
select e.vec_id, coalesce(n, 0) as n_links, component_id, e.vec_id = component_id as kept
from embeddings e join least on least.a = e.vec_id left join counted on counted.a = e.vec_id
"""


def op10_token_store(spark: SparkSession, folder: str) -> DataFrame:
    path = fresh_dir(spark, "token-store")
    token_store.write_store(table(spark, folder, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_store.read_digests(spark, path)


def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, folder, "conversations"))


def op12_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = toxicity.fit(docs, table(spark, folder, "labels"))
    return toxicity.scores(docs, model).select(
        "doc_id",
        toxicity.held_out("doc_id").alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(table(spark, folder, "documents"))


def queries() -> dict[str, Query]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_sentencepiece": op2_sentencepiece,
        "op3_mixing": op3_mixing,
        "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
        "op5_quality_classifier": op5_quality_classifier,
        "op6_suffix_dedup": op6_suffix_dedup,
        "op7_exact_topk": op7_exact_topk,
        "op8_license_scan": op8_license_scan,
        "op9_embedding_near_dedup": op9_embedding_near_dedup,
        "op10_token_store": op10_token_store,
        "op11_prefix_trie": op11_prefix_trie,
        "op12_toxicity": op12_toxicity,
        "op13_spelling_variants": op13_spelling_variants,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_ngram_jaccard_join": OP4_SQL,
        "op7_exact_topk": OP7_SQL,
        "op9_embedding_near_dedup": OP9_SQL,
        "op11_prefix_trie": OP11_SQL,
        "op13_spelling_variants": OP13_SQL,
    }
