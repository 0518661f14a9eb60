"""Keyed collections of integer containers: one long table (id, pos, element[, attribute]).

A point load is a filter on id. Data is range-sorted by id on write, so Parquet
row-group statistics prune it; append and upsert keep "last write wins" per id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("pos", T.LongType()), T.StructField("element", T.LongType()), T.StructField("attribute", T.LongType())])


def from_values(spark: SparkSession, id: int, values: list[int], attributes: list[int] | None = None) -> DataFrame:
    """One container from driver values (arguments or parsed input)."""
    if attributes is not None and len(attributes) != len(values):
        raise ValueError("values and attributes differ in length")
    return spark.createDataFrame([(id, i, v, attributes[i] if attributes else None) for i, v in enumerate(values)], SCHEMA)


def parse_values(text: str) -> list[int]:
    """Count-prefixed integers: '3 5 0x10 7' gives [5, 16, 7]; too few values raise ValueError."""
    read = [int(t, 8) if len(t) > 1 and t[0] == "0" and t.isdigit() else int(t, 0) for t in text.split()]
    if not read or read[0] < 0 or len(read) - 1 < read[0]:
        raise ValueError("expected a count and that many integers")
    return read[1 : read[0] + 1]


def save(df: DataFrame, path: str, mode: str = "append", files: int = 8) -> None:
    """Write containers sorted by id so that loads by id prune row groups."""
    df.repartitionByRange(files, "id").sortWithinPartitions("id", "pos").write.mode(mode).parquet(path)


def load(spark: SparkSession, path: str, id: int) -> DataFrame:
    """One container; an unknown id gives no rows."""
    return spark.read.schema(SCHEMA).parquet(path).where(F.col("id") == id)


def replace(spark: SparkSession, path: str, new: DataFrame, to: str) -> None:
    """The store at path with new's containers in place of those of equal id, written to another folder."""
    save(upsert(spark.read.schema(SCHEMA).parquet(path), new), to, "overwrite")


def upsert(current: DataFrame, new: DataFrame) -> DataFrame:
    """Replace whole containers by id: rows of ids in new come from new alone."""
    return current.join(new.select("id").distinct(), "id", "left_anti").unionByName(new)


def elements(container: DataFrame) -> DataFrame:
    """The elements in ascending order."""
    return container.select("element").orderBy("element")

