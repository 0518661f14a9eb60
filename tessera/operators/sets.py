"""Set algebra on one-column DataFrames; results are sets unless noted."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def intersect_all(sets: list[DataFrame]) -> DataFrame:
    """k-way intersection as one union and one aggregate instead of k-1 joins."""
    if not sets:
        raise ValueError("no sets")
    c = sets[0].columns[0]
    tagged = [s.toDF(c).select(c, F.lit(i).alias("_s")) for i, s in enumerate(sets)]
    return reduce(DataFrame.unionByName, tagged).groupBy(c).agg(F.countDistinct("_s").alias("_n")).where(F.col("_n") == len(sets)).select(c)


def keep_members(bag: DataFrame, members: DataFrame) -> DataFrame:
    """Rows of a bag that are in a set: repeats stay."""
    return bag.join(members, bag.columns[0], "left_semi")


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Elements of exactly one side: one union and one aggregate."""
    c = a.columns[0]
    tagged = a.toDF(c).select(c, F.lit(1).alias("_s")).union(b.toDF(c).select(c, F.lit(2).alias("_s")))
    return tagged.groupBy(c).agg(F.min("_s").alias("_a"), F.max("_s").alias("_b")).where("_a = _b").select(c)


def complement(a: DataFrame, universe: DataFrame) -> DataFrame:
    return universe.subtract(a)


def cardinality(a: DataFrame) -> DataFrame:
    return a.agg(F.countDistinct(a.columns[0]).alias("n"))


def elements(a: DataFrame) -> DataFrame:
    return a.distinct().orderBy(a.columns[0])


def contains(a: DataFrame, value: int) -> bool:
    return bool(a.where(F.col(a.columns[0]) == value).take(1))


def add(a: DataFrame, values: list[int]) -> DataFrame:
    return union(a, a.sparkSession.createDataFrame([(v,) for v in values], a.schema))


def append_shifted(a: DataFrame, b: DataFrame, offset: int) -> DataFrame:
    """b's positions after a's: bitmap append."""
    c = b.columns[0]
    return union(a, b.select((F.col(c) + offset).alias(c)))


def equal(a: DataFrame, b: DataFrame) -> bool:
    return not symmetric_difference(a, b).take(1)
