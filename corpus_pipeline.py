"""The corpus pipeline: five stages over documents, each written as Parquet and read again.

1. toxicity: documents predicted toxic go. The lexicon and its weights are learned from
   labels beside the documents.
2. simhash: one document of each group of near duplicates stays, that with the smallest
   doc_id. Words are lower-cased runs without punctuation, shingles have five words, and
   documents link if their sets of distinct shingles have a Jaccard similarity of 0.8 or
   more. A binary-trie join of 256-bit SimHash fingerprints proposes what is compared; short
   texts are proposed by their shingles.
3. substrings: words in passages of 13 words or more that a smaller document has are removed.
4. decontamination: documents that overlap a benchmark item go.
5. packing: the rest is cut into power-of-two sequences.

Stages 1 to 4 return the columns of their input. Repeated rows and rows that share a doc_id
or have none are handled as the operators state; of repeated rows of one group, one stays.
Each stage's folder is deleted when the next is written; the last, which holds the result, is
the caller's.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, near, packing, substrings, toxicity
from tessera.llm.common import remove, shared_folder

SHINGLE, SIMILARITY = 5, 0.8


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.learn(docs, labels))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near.keep_one(docs, size=SHINGLE, similarity=SIMILARITY)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = substrings.remove_repeats(docs)
    columns = {c: F.col(f"row.`{c}`") for c in docs.columns}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("n_removed") > 0, F.length("row.text").cast(docs.schema["n_chars"].dataType)).otherwise(columns["n_chars"])
    return done.select(*[e.alias(c) for c, e in columns.items()])


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash", simhash_stage),
    ("substrings", substring_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

# Learned weights, trie joins and tokenizers are beyond SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, before)
        before = f"{folder}/{name}"
    return docs
