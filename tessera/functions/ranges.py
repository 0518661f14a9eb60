"""Range numbers by bisection over sorted bounds, in generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bisect(df: DataFrame, key: str, bounds: Column, count: int, name: str) -> DataFrame:
    """df with name: how many of the ascending bounds a key has reached, one look-up a step; a null key has reached none."""
    out = df.withColumn(name, F.lit(0))
    for step in (1 << b for b in range(count.bit_length() - 1, -1, -1)):
        reached = F.coalesce(F.get(bounds, F.col(name) + step - 1) <= F.col(key), F.lit(False))
        out = out.withColumn(name, F.when(reached, F.col(name) + step).otherwise(F.col(name)))
    return out


def sampled_bounds(df: DataFrame, key: str, parts: int, drawn: int = 10_000) -> list:
    """At most parts - 1 ascending values of a column that cut its rows into about equal parts, from about `drawn` rows."""
    n = df.count()
    if parts < 2 or not n:
        return []
    found = sorted(r[0] for r in df.where(F.col(key).isNotNull() & (F.rand(5) < drawn / n)).select(key).collect())
    return sorted({found[len(found) * i // parts] for i in range(1, parts)}) if found else []
