"""A training corpus built from ``documents``: five stages, each stored as Parquet and read again by the next.

1. quality classifier: documents scored below the threshold go.
2. n-gram Jaccard join, on shingles of ``NEAR_WORDS`` words and a similarity of ``NEAR_PERCENT`` / 100: of each group of
   near copies the document with the smallest doc_id stays; rows without a doc_id stay. Rows are told apart by doc_id
   and text: rows that repeat both become one, other texts under a repeated doc_id are documents of their own.
3. suffix-array dedup: strings of ``PASSAGE_BYTES`` bytes that repeat anywhere in what is left are cut out of the texts.
4. mixing: documents are taken as often as their source's target weight asks, and shuffled over shards.
5. SentencePiece: every text is encoded and decoded; adds n_pieces, piece_ids, ids_crc32 and decoded.

All stages but the last return the columns of their input, whatever these are.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldledger.llm import jaccard_join, mixing, quality, sentencepiece_codec, suffix_dedup
from fieldledger.llm.common import frugal, reach_workers, saved, table, told, unused

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


#: The near-copy stage; the operator by itself has other defaults.
NEAR_WORDS = 5
NEAR_PERCENT = 80
#: Bytes of a passage that the dedup stage takes out: nearly all runs of 51 words have as many.
PASSAGE_BYTES = 200


def _ready(spark: SparkSession) -> None:
    reach_workers(spark)
    # Executors and their Python workers live through all stages; texts and packed postings are long rows.
    frugal(spark)


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    return quality.accepted(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    # A row is known by its doc_id and text together: texts that share a doc_id are judged each by itself.
    key = unused(docs, "_row")
    rows = docs.where("doc_id is not null").withColumn(key, F.xxhash64("doc_id", "text"))
    found = jaccard_join.similar(rows.select(F.col(key).alias("doc_id"), "text"), NEAR_WORDS, NEAR_PERCENT)
    found = found.groupBy(F.col("doc_id").alias(key), "component_id").agg(F.count("*").alias("n_rows"))
    known = saved(found.join(rows.select(key, "doc_id").distinct(), key), "groups")
    first = known.groupBy("component_id").agg(F.min(F.struct("doc_id", key)).alias("first")).select(f"first.{key}")
    first = saved(first, "first")
    # Texts are shuffled only where a row repeats or a filter can't tell it from one that goes.
    others = known.select(key).join(first, key, "left_anti").unionByName(known.where("n_rows > 1").select(key))
    sure, several = told(rows, key, first, others)
    # Rows of one doc_id and text become the least of them.
    columns = [f"`{c}`" for c in docs.columns]
    least = several.groupBy(key).agg(F.min(F.struct(*columns)).alias("row")).select("row.*")
    return sure.select(*columns).unionByName(least).unionByName(docs.where("doc_id is null"))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    clean = suffix_dedup.cleaned(docs, PASSAGE_BYTES)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    return mixing.draw(docs, mixing.plan(docs)).select("row.*")


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    model = public_tokenizers.path("piece_bpe_32k.model")
    return sentencepiece_codec.encoded(docs, model)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", good_documents),
    ("n-gram Jaccard join", one_of_each),
    ("suffix-array dedup", without_repeats),
    ("mixing sources to target weights", mixed),
    ("SentencePiece encoding and decoding", tokenized),
]

#: SQL can't express the classifier, the seeded mix or the tokenizer; tests hold the stages to brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES, 1):
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{i}")
    return docs
