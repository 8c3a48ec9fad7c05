"""From raw documents to token ids: language ID, near-dedup, passage dedup, mixing and encoding.

A stage takes the documents its predecessor kept and returns documents, the last one token ids. Each stage can also be
run alone: ``run`` writes the result of every stage to the shared folder and reads it back for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallycast.llm.bitmap import bitmap, marked
from tallycast.llm.bpe import encode_documents
from tallycast.llm.graph import written
from tallycast.llm.language_id import learn_languages, predict_language
from tallycast.llm.minhash_dedup import near_duplicates
from tallycast.llm.mixing import mixed_documents
from tallycast.llm.paragraph_dedup import drop_repeated_paragraphs

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOKENIZER = "byte_bpe_50k.json"


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: null texts and texts without a letter go. ``lang`` becomes the predicted language."""
    found = predict_language(docs, learn_languages(docs), carry=COLUMNS)
    return found.where("lang_pred <> 'und'").withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, and one of equal rows. Rows without an id stay; equal ids stay together."""
    gone = near_duplicates(docs).where("not kept").select("doc_id")
    several = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    flagged = marked(docs.select(*COLUMNS), written(bitmap(several, "doc_id", 22), "bitmap"), "doc_id", 22)
    once = flagged.where("not marked").drop("marked").unionByName(flagged.where("marked").drop("marked").dropDuplicates())
    return once.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat an earlier document are cut out; documents of which no word is left go."""
    left = drop_repeated_paragraphs(docs.select(*COLUMNS)).where("n_words > n_removed")
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, a row each time, in the order of the mix."""
    return mixed_documents(docs.select(*COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``[doc_id, n_tokens, ids]`` for every document of the mix."""
    return encode_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("language", keep_languages), ("near_duplicates", keep_one_of_each), ("passages", cut_repeated_passages),
    ("mix", mix_sources), ("encode", encode),
]

#: No stage but the mix can be written in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{str(sf_dir).rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
