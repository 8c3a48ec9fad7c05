"""The operators of this package as named queries over the given tables, and the SQL some are checked against."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallycast.llm.bpe import encode_documents
from tallycast.llm.bwt_dedup import drop_repeated_strings
from tallycast.llm.collocations import mine_collocations
from tallycast.llm.cotraining import score_quality, train_quality
from tallycast.llm.embedding_dedup import near_duplicate_vectors
from tallycast.llm.hamming_search import TOP_K, embedding_top_k
from tallycast.llm.hard_negatives import mine_hard_negatives
from tallycast.llm.language_id import learn_languages, predict_language
from tallycast.llm.minhash_dedup import near_duplicates
from tallycast.llm.mixing import mix_sources
from tallycast.llm.oracle_mixing import MIXING
from tallycast.llm.oracle_negatives import NEGATIVES
from tallycast.llm.oracle_phrases import PHRASES
from tallycast.llm.paragraph_dedup import drop_repeated_paragraphs
from tallycast.llm.toxicity import score_toxicity, train_toxicity
from tallycast.llm.url_rules import judge_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]):
    QUERIES[build.__name__] = build
    return build


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")


@query
def op1_url_rules(spark, sf_dir):
    return judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


@query
def op2_hamming_top_k(spark, sf_dir):
    return embedding_top_k(table(spark, sf_dir, "embeddings"))


ORACLES["op2_hamming_top_k"] = TOP_K


@query
def op3_source_mixing(spark, sf_dir):
    return mix_sources(table(spark, sf_dir, "documents")).drop("copies", "virtual_finish")


ORACLES["op3_source_mixing"] = MIXING


@query
def op4_suffix_dedup(spark, sf_dir):
    cut = drop_repeated_strings(table(spark, sf_dir, "documents"))
    return cut.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("span_starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query
def op5_substring_dedup(spark, sf_dir):
    return drop_repeated_paragraphs(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "n_spans", "text")


@query
def op6_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return predict_language(docs, learn_languages(docs))


@query
def op7_quality_cotraining(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, train_quality(docs, table(spark, sf_dir, "labels")))


@query
def op8_embedding_dedup(spark, sf_dir):
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


@query
def op9_bpe_round_trip(spark, sf_dir):
    coded = encode_documents(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), packed=True, decode=True)
    return coded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query
def op10_minhash_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


@query
def op11_hard_negatives(spark, sf_dir):
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    known = table(spark, sf_dir, "embeddings").where("label is not null and embedding is not null").where(finite)
    relabelled = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    coded = known.select("vec_id", relabelled.alias("label"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("code"))
    return mine_hard_negatives(coded, F.col("vec_id") % 100 == 0)


ORACLES["op11_hard_negatives"] = NEGATIVES


@query
def op12_phrase_collocations(spark, sf_dir):
    return mine_collocations(table(spark, sf_dir, "documents"))


ORACLES["op12_phrase_collocations"] = PHRASES


@query
def op13_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, train_toxicity(docs, table(spark, sf_dir, "labels")))
