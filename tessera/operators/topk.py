"""Term rankings over document lists. Ties go to the smaller key.

A list of documents is a bag (a repeated document counts again) unless the
operator says set. Scores are bigint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.division import docs_in_context, rows_in_context


def top_k(df: DataFrame, key: str, score: str, k: int) -> DataFrame:
    """First k rows by score descending, key ascending; planned as TakeOrderedAndProject."""
    if k < 0:
        raise ValueError("k must not be negative")
    return df.orderBy(F.desc(score), F.asc(key)).limit(k)


def topk_with_ties(df: DataFrame, key: str, score: str, k: int) -> DataFrame:
    """All rows whose rank by score is at most k. The k-th score is found by a top-k first, so no global window is needed."""
    if k <= 0:
        if k < 0:
            raise ValueError("k must not be negative")
        return df.limit(0)
    least = df.select(score).orderBy(F.desc(score)).limit(k).agg(F.min(score).alias("_least"))
    return df.join(F.broadcast(least), F.col(score) >= F.col("_least")).drop("_least")


def term_counts(dt: DataFrame, docs: DataFrame) -> DataFrame:
    return docs.select("doc").join(dt, "doc").groupBy("term").agg(F.count("*").alias("score"))


def tf_sum_per_term(dt: DataFrame, docs: DataFrame) -> DataFrame:
    return docs.select("doc").join(dt, "doc").groupBy("term").agg(F.sum("freq").alias("score"))


def topk_terms(dt: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    return top_k(term_counts(dt, docs), "term", "score", k)


def topk_tf(dt: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    return top_k(tf_sum_per_term(dt, docs), "term", "score", k)


def topk_tf_set(dt: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """docs as a set: a semi-join, so repeats do not count."""
    hits = dt.join(docs.select("doc"), "doc", "left_semi")
    return top_k(hits.groupBy("term").agg(F.sum("freq").alias("score")), "term", "score", k)


def topk_terms_in_context(dt: DataFrame, terms, k: int) -> DataFrame:
    return topk_terms(dt, docs_in_context(dt, terms), k)


def topk_tf_in_context(dt: DataFrame, terms, k: int) -> DataFrame:
    return topk_tf(dt, docs_in_context(dt, terms), k)


def topk_words_in_context(rows: DataFrame, words: str, terms, k: int) -> DataFrame:
    """topk_tf_in_context where a document is one row with its words, repeats included: one scan, and only words and counts move."""
    held = rows_in_context(rows, words, terms).select(F.explode(words).alias("term"))
    return top_k(held.groupBy("term").agg(F.count("*").alias("score")), "term", "score", k)


def dual_lists(dt: DataFrame) -> DataFrame:
    """(doc, terms, freqs): two positional lists for each document."""
    pairs = F.sort_array(F.collect_list(F.struct("term", "freq")))
    return dt.groupBy("doc").agg(pairs.alias("_p")).select("doc", F.col("_p.term").alias("terms"), F.col("_p.freq").alias("freqs"))


def topk_tf_dual_list(lists: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """topk_tf over dual lists: zip both lists by position, then sum."""
    pairs = docs.select("doc").join(lists, "doc").select(F.explode(F.arrays_zip("terms", "freqs")).alias("p"))
    return top_k(pairs.groupBy(F.col("p.terms").alias("term")).agg(F.sum("p.freqs").alias("score")), "term", "score", k)


def dense_counts(counts: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Every key of dim, with 0 where counts has none. A counted key outside dim raises when rows are read."""
    joined = dim.select(key).distinct().withColumn("_in", F.lit(1)).join(counts, key, "full_outer")
    checked = F.when(F.col("_in").isNull(), F.raise_error(F.lit("key out of range")).cast("long")).otherwise(F.coalesce("score", F.lit(0)))
    return joined.select(key, checked.alias("score"))


def rank_terms(df: DataFrame, group: str, score: str = "score") -> DataFrame:
    """Rank within each group, ties sharing a rank."""
    return df.withColumn("rank", F.rank().over(W.partitionBy(group).orderBy(F.desc(score))))
