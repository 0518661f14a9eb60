"""Group-size histograms: derived from relations, or read from count-prefixed integer text."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCALE_INPUT_SKEW = 1.75  # factor that the skewed authors-per-document input uses


def docs_per_term(dt: DataFrame) -> DataFrame:
    return dt.groupBy("term").agg(F.count("*").alias("n"))


def terms_per_doc(dt: DataFrame) -> DataFrame:
    return dt.groupBy("doc").agg(F.count("*").alias("n"))


def docs_per_author(da: DataFrame) -> DataFrame:
    return da.groupBy("author").agg(F.count("*").alias("n"))


def authors_per_doc(da: DataFrame, scale: float = 1.0) -> DataFrame:
    """scale multiplies each size and truncates it, as the skewed input does with 1.75."""
    return da.groupBy("doc").agg(F.floor(F.count("*") * F.lit(scale)).alias("n"))


def group_size(hist: DataFrame, key: str, value) -> DataFrame:
    """(n): the size of one group of a histogram; no row for an unknown key."""
    return hist.where(F.col(key) == value).select("n")


def random_group(hist: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """One group of a histogram, drawn by a seeded hash of its key: the same in every run."""
    return hist.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(1)


def relation_stats(dt: DataFrame, da: DataFrame) -> DataFrame:
    """Grand totals of both relations as (stat, value) rows."""
    a = dt.agg(F.count("*").alias("dt_tuples"), F.countDistinct("doc").alias("docs"), F.countDistinct("term").alias("terms"), F.sum("freq").alias("total_freq"))
    b = da.agg(F.count("*").alias("da_tuples"), F.countDistinct("author").alias("authors"))
    return a.unpivot([], a.columns, "stat", "value").unionByName(b.unpivot([], b.columns, "stat", "value"))


def read_histogram(spark: SparkSession, path: str) -> DataFrame | None:
    """(key, n) rows of a text file holding N and then N sizes; keys run 0..N-1.

    A missing file gives None, so that a caller may go on without it. Accepts decimal,
    0x and 0-octal integers. The file is one small header table, so it is read whole.
    """
    try:
        lines = spark.read.text(path, wholetext=True)
    except AnalysisException:
        return None
    tokens = lines.select(F.posexplode(F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")).alias("p", "v"))
    value = (
        F.when(F.col("v").rlike("^[+-]?0[xX]"), F.conv(F.regexp_replace("v", "0[xX]", ""), 16, 10))
        .when(F.col("v").rlike("^[+-]?0[0-7]+$"), F.conv("v", 8, 10))
        .otherwise(F.col("v"))
        .cast("long")
    )
    rows = tokens.where("v <> ''").select("p", value.alias("n"))
    size = rows.where("p = 0").select(F.col("n").alias("size"))
    return rows.where("p > 0").join(F.broadcast(size), F.col("p") <= F.col("size")).select((F.col("p") - 1).cast("long").alias("key"), "n")
