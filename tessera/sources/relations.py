"""The three logical relations and their derivation from the driver tables.

dt(doc, term, freq) is canonical: unique on (doc, term), frequencies summed.
da(doc, author) is a set of pairs. dy(doc, year) is one row per document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DT_SCHEMA = T.StructType([T.StructField(c, T.LongType()) for c in ("doc", "term", "freq")])
DA_SCHEMA = T.StructType([T.StructField(c, T.LongType()) for c in ("doc", "author")])
DY_SCHEMA = T.StructType([T.StructField("doc", T.LongType()), T.StructField("year", T.IntegerType())])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def canonical_dt(df: DataFrame) -> DataFrame:
    """Collapse duplicate (doc, term) rows by summing freq; rows with a null key are dropped."""
    return (
        df.select(F.col("doc").cast("long"), F.col("term"), F.col("freq").cast("long"))
        .where(F.col("doc").isNotNull() & F.col("term").isNotNull())
        .groupBy("doc", "term")
        .agg(F.sum(F.coalesce("freq", F.lit(0))).alias("freq"))
    )


def load_dt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents, parts as terms, whole quantities as frequencies."""
    return canonical_dt(
        table(spark, sf_dir, "lineitem").select(
            F.col("l_orderkey").alias("doc"), F.col("l_partkey").alias("term"), F.col("l_quantity").cast("long").alias("freq")
        )
    )


def load_da(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents, suppliers as authors."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_suppkey").alias("author")).distinct()


def load_dy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"), F.year("o_orderdate").alias("year"))


def load_words(spark: SparkSession, sf_dir: str, holding: tuple[str, ...] = ()) -> DataFrame:
    """(doc, words): the lower-case a-z words of each document, in order.

    holding: words that the texts must contain at least as substrings; a cheap test that
    spares the others' splitting.
    """
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.lower("text").alias("t"))
    for w in holding:
        rows = rows.where(F.contains("t", F.lit(w)))
    return rows.select("doc", F.filter(F.split("t", "[^a-z]+"), lambda w: w != "").alias("words"))


def load_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text-real dt: lower-case a-z words of documents.text with their counts."""
    words = load_words(spark, sf_dir).select("doc", F.explode("words").alias("term"))
    return words.groupBy("doc", "term").agg(F.count("*").alias("freq"))
