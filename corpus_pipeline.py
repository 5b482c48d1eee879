"""From documents to training shards: toxic documents go, one document of each group of near copies
stays, documents with benchmark passages go, sources are mixed to target weights, and what is
left is sharded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of docs. run() writes every stage's rows to the shared folder and rereads them for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pairloom.llm import decontam, jaccard, mixing, sharding, toxicity
from pairloom.llm.common import Store, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the class-conditional models reject go; learns from labels of the documents at hand."""
    return toxicity.keep_ordinary(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word shingle sets with a Jaccard similarity of 0.8 or more stays."""
    return jaccard.keep_one(docs, words=5, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in which a benchmark item is found, whole and within its edit budget, go."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as its source's target weight takes it: not at all, once or twice."""
    return mixing.mix(docs)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    return sharding.assign(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("sharding", assign_shards),
]

#: SQL cannot express the language models, the cube method and label propagation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = store.write(stage(spark, docs, sf_dir))
        store.release()
    return docs
