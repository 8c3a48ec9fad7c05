"""The stages of the corpus pipeline on the smallest tables, each against what its operator says."""

import collections

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from tallycast.llm.graph import written


def test_stages_on_the_smallest_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.unionByName(spark.createDataFrame([(10_001, None, None, None, None), (10_002, "12 34", None, "src0", 5)], docs.schema))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        kept[name] = written(stage(spark, docs if not kept else kept[list(kept)[-1]], sf_dir), name)
    texts = {r.doc_id: r.text for r in docs.collect()}
    language = {r.doc_id: r for r in kept["language"].collect()}
    assert set(texts) - set(language) == {10_001, 10_002}
    assert all(kept[n].columns == corpus_pipeline.COLUMNS for n in list(kept)[:-1])
    near = kept["near_duplicates"].select("doc_id").collect()
    assert len(near) == len(set(near)) and 0 < len(near) < len(language)
    passages = {r.doc_id: r for r in kept["passages"].collect()}
    assert all(r.n_chars == len(r.text) <= len(texts[i]) for i, r in passages.items())
    mixed = collections.Counter(r.doc_id for r in kept["mix"].collect())
    assert set(mixed) <= set(passages) and max(mixed.values()) <= 3
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    coded = kept["encode"].collect()
    assert collections.Counter(r.doc_id for r in coded) == mixed
    assert all(list(r.ids) == library.encode(passages[r.doc_id].text, add_special_tokens=False).ids for r in coded)


def test_pipeline_of_nothing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0


def test_one_of_equal_rows_stays(spark):
    text = "one two three four five six seven"
    rows = [(1, text, "en", "s", 33)] * 3 + [(2, text + " eight", "en", "s", 39), (2, "quite another text of six words", "en", "s", 31)]
    df = spark.createDataFrame(rows + [(None, text, "en", "s", 33)], "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.keep_one_of_each(spark, df, "").collect()
    assert sum(r.doc_id == 1 for r in left) == 1 and sum(r.doc_id is None for r in left) == 1


def test_every_operator_is_registered():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()
