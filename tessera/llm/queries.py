"""The registered queries of this subpackage; their SQL, where SQL can express them, is in oracles."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import chat, decontaminate, fingerprints, langid, packing, simhash, substrings, token_counts, toxicity, warc
from tessera.llm.common import documents
from tessera.llm.oracles import SQL as SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


@_query
def op6_simhash(spark, sf_dir):
    found = simhash.near_duplicates(documents(spark, sf_dir), size=4, budget=4)
    return found.select("doc_id", F.lower(F.hex("fingerprint")).alias("fingerprint"), "component_id")


@_query
def op10_packing(spark, sf_dir):
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), keep_ids=False).drop("ids")


@_query
def op1_token_counts(spark, sf_dir):
    return token_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


@_query
def op2_toxicity(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


@_query
def op4_language(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return langid.identify(docs, langid.learn(docs))


@_query
def op5_decontamination(spark, sf_dir):
    return decontaminate.overlaps(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_query
def op9_substrings(spark, sf_dir):
    return substrings.remove_repeats(documents(spark, sf_dir).select("doc_id", "text")).select("row.doc_id", "n_words", "n_removed", "kept_sha256")


@_query
def op7_fingerprints(spark, sf_dir):
    return fingerprints.with_edits(documents(spark, sf_dir))


@_query
def op8_warc(spark, sf_dir):
    folder = warc.write(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return warc.read(spark, folder).drop("target_uri")


PROBE = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


@_query
def op3_chat(spark, sf_dir):
    """All conversations and one whose texts are control strings."""
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame(PROBE, "conv_id long, turn long, role string, text string")
    return chat.read(chat.windows(table.unionByName(probe), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))
