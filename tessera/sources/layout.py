"""Stored copies of the relations: bucketed tables, and a sorted column store with a run directory.

Bucketed copies make groupings and joins on their key free of exchanges. The column store
keeps dt sorted by a key; its directory names, for each key, the file that holds the key's run,
where the run starts in it and how long it is, so a look-up reads those rows alone.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.shared import new_folder, remove


@dataclass(frozen=True)
class Bucketed:
    """dt by document and by term, da by document, each bucketed and sorted by that key."""

    dt_doc: DataFrame
    dt_term: DataFrame
    da_doc: DataFrame
    names: tuple[str, ...] = ()

    def drop(self) -> None:
        for name in self.names:
            self.dt_doc.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")


def bucketed(dt: DataFrame, da: DataFrame, buckets: int = 8, folder: str | None = None) -> Bucketed:
    """Write the three copies as tables under a folder, the shared one unless given. The caller drops them."""
    spark = dt.sparkSession
    folder = folder or new_folder(spark, "bucketed")
    mark = folder.rstrip("/").rpartition("-")[2]
    out, names = [], []
    for name, df, key in (("dt_doc", dt, "doc"), ("dt_term", dt, "term"), ("da_doc", da, "doc")):
        names.append(f"{name}_{mark}")
        # one file for each bucket: dealt as the buckets are, so that a task writes one of them
        df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", f"{folder}/{name}").mode("overwrite").saveAsTable(names[-1])
        out.append(spark.table(names[-1]))
    return Bucketed(*out, tuple(names))


class ColumnStore:
    """dt sorted by a key in `files` ranges, with its directory (key, part, start, length)."""

    def __init__(self, spark: SparkSession, path: str, key: str) -> None:
        self.spark, self.path, self.key = spark, path, key

    @classmethod
    def write(cls, dt: DataFrame, key: str, path: str | None = None, files: int = 8) -> ColumnStore:
        spark = dt.sparkSession
        path = path or new_folder(spark, f"columns-{key}")
        other = "doc" if key == "term" else "term"
        # ids count up within a partition, above 33 bits that hold its number
        row = F.monotonically_increasing_id()
        dt.repartitionByRange(files, key, other).sortWithinPartitions(key, other).withColumn("_r", row).select(*dt.columns, F.shiftright("_r", 33).cast("int").alias("part"), F.col("_r").bitwiseAND(F.lit((1 << 33) - 1)).alias("row")).write.mode("overwrite").parquet(f"{path}/rows")
        rows = spark.read.parquet(f"{path}/rows")
        directory = rows.groupBy(key, "part").agg(F.min("row").alias("start"), F.count("*").alias("length"))
        directory.repartitionByRange(files, key).sortWithinPartitions(key, "part").write.mode("overwrite").parquet(f"{path}/directory")
        return cls(spark, path, key)

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def directory(self) -> DataFrame:
        """(key, part, start, length); a key whose run spans files has a row for each."""
        return self.spark.read.parquet(f"{self.path}/directory")

    def lookup(self, keys: list) -> DataFrame:
        """The rows of some keys, read by the row ranges that the directory gives; unknown keys give none."""
        found = self.directory().where(F.col(self.key).isin(keys)).collect()  # a row for each key and file
        rows = self.rows().drop("part", "row")
        if not found:
            return rows.limit(0)
        spans = (((F.col("part") == r["part"]) & F.col("row").between(r["start"], r["start"] + r["length"] - 1)) for r in found)
        return self.rows().where(reduce(lambda a, b: a | b, spans)).drop("part", "row")

    def drop(self) -> None:
        remove(self.spark, self.path)


def docs_in_context(by_term: ColumnStore, terms: list) -> DataFrame:
    """doc of every document that holds all terms, by directory look-ups."""
    wanted = sorted(set(terms))
    if not wanted:
        raise ValueError("a context needs at least one term")
    return by_term.lookup(wanted).groupBy("doc").agg(F.countDistinct("term").alias("_n")).where(F.col("_n") == len(wanted)).select("doc")


def cooccurrence(by_doc: ColumnStore, by_term: ColumnStore, seed: int) -> DataFrame:
    """(doc, score, tf): terms that each document shares with the seed, and the sum of its frequencies of them, by two look-ups."""
    terms = [r["term"] for r in by_doc.lookup([seed]).select("term").distinct().collect()]  # of one document
    return by_term.lookup(terms).groupBy("doc").agg(F.count("*").alias("score"), F.sum("freq").alias("tf"))
