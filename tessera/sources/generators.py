"""Random inputs by Spark expressions: seeded, so a run can be repeated."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def random_list(spark: SparkSession, count: int, maximum: int, seed: int = 42) -> DataFrame:
    """A bag of count draws from 0..maximum-1."""
    return spark.range(count).select(F.floor(F.rand(seed) * maximum).alias("element"))


def random_set(spark: SparkSession, count: int, maximum: int, seed: int = 42) -> DataFrame:
    return random_list(spark, count, maximum, seed).distinct()


def random_map(spark: SparkSession, count: int, maximum: int, attributes: int = 256, seed: int = 42) -> DataFrame:
    """Unique keys, each with one attribute."""
    return random_list(spark, count, maximum, seed).groupBy("element").agg(F.floor(F.rand(seed + 1) * attributes).alias("attribute"))


def skewed_frequency(seed: int = 42):
    """Frequencies 1..6 with shares 25, 20, 15, 10, 5 and 2 %, the rest uniform below 40."""
    r = F.rand(seed)
    return F.when(r < 0.25, 1).when(r < 0.45, 2).when(r < 0.60, 3).when(r < 0.70, 4).when(r < 0.75, 5).when(r < 0.77, 6).otherwise(F.floor(F.rand(seed + 1) * 40)).cast("long")


def byte_frequency(seed: int = 42):
    """Frequencies that are any byte in 20 % of draws, else below 15."""
    r = F.rand(seed)
    return F.when(r < 0.20, F.floor(F.rand(seed + 1) * 256)).otherwise(F.floor(F.rand(seed + 2) * 15)).cast("long")


def tuples_from_histogram(hist: DataFrame, key: str, value_range: int, seed: int = 42) -> DataFrame:
    """n rows for each key of a (key, n) histogram, each with a random value."""
    return hist.select(key, F.explode(F.expr("sequence(1L, n)")).alias("_i")).select(key, F.floor(F.rand(seed) * value_range).alias("value"))


def fragments(tuples: DataFrame, key: str, value: str) -> DataFrame:
    """(key, elements): the sorted list of each key's values."""
    return tuples.groupBy(key).agg(F.sort_array(F.collect_list(value)).alias("elements"))


def fragment_differences(lists: DataFrame, key: str, positions: DataFrame) -> DataFrame:
    """(key, position, missing_in): members that a list has and its bitmap has not, or the other way round; none if both hold the same."""
    a = lists.select(F.col(key).alias("key"), F.explode("elements").alias("position")).distinct()
    b = positions.select("key", "position")
    return a.exceptAll(b).withColumn("missing_in", F.lit("bitmap")).unionByName(b.exceptAll(a).withColumn("missing_in", F.lit("list")))


def shuffled(df: DataFrame, seed: int = 42) -> DataFrame:
    """All rows in a seeded random order (a distributed range sort on the draw)."""
    return df.orderBy(F.rand(seed))


def parameter_lists(sizes: list[int], maximum: int, seed: int) -> dict[int, list[int]]:
    """Fixed query parameters: for each size, that many ids, the same in every run."""
    import random

    draw = random.Random(seed)
    return {n: [draw.randrange(maximum) for _ in range(n)] for n in sizes}
