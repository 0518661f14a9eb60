"""Bitmaps in buckets: (key, bucket, bits), one row for each non-empty bucket of 32,768 positions.

Bits come from and go to rows by built-in aggregates; AND and OR over many bitmaps are
aggregates as well. Word-wise operations on two bitmaps join their buckets and work on whole
buckets in Arrow batches. A position is a document id, dealt to buckets as
Spark's bitmap functions do: bucket 1 holds 1 to 32,768.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET_BITS = 32_768
SCHEMA = "key long, bucket long, bits binary"


def from_rows(rows: DataFrame, key: str, position: str, sparse: bool = False) -> DataFrame:
    """The positions of each key as bitmaps.

    sparse: for rows that hardly repeat and are few in a bucket. These move as they are and
    become a bitmap of 4,096 bytes only where it stays; else partial bitmaps move.
    """
    if sparse:
        dealt = rows.select(F.col(key).alias("key"), F.expr(f"bitmap_bucket_number({position})").alias("bucket"), F.expr(f"bitmap_bit_position({position})").alias("_bit")).repartition("key", "bucket")
        return dealt.groupBy("key", "bucket").agg(F.expr("bitmap_construct_agg(_bit)").alias("bits"))
    return rows.groupBy(F.col(key).alias("key"), F.expr(f"bitmap_bucket_number({position})").alias("bucket")).agg(F.expr(f"bitmap_construct_agg(bitmap_bit_position({position}))").alias("bits"))


def save(bitmaps: DataFrame, path: str, files: int = 8) -> None:
    """Written sorted by key and bucket, so that a load by key reads the row groups of that key alone."""
    bitmaps.repartitionByRange(files, "key", "bucket").sortWithinPartitions("key", "bucket").write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str, keys: list | None = None) -> DataFrame:
    found = spark.read.schema(SCHEMA).parquet(path)
    return found if keys is None else found.where(F.col("key").isin(keys))


def cardinality(bitmaps: DataFrame) -> DataFrame:
    """(key, n): set bits of each key."""
    return bitmaps.groupBy("key").agg(F.sum(F.expr("bitmap_count(bits)")).alias("n"))


def all_of(bitmaps: DataFrame, keys: list) -> DataFrame:
    """AND over keys, as the bitmap of key 0. Repeated keys count once."""
    n = len(set(keys))
    anded = bitmaps.where(F.col("key").isin(list(set(keys)))).groupBy("bucket").agg(F.expr("bitmap_and_agg(bits)").alias("bits"), F.count("*").alias("_n"))
    return anded.where(F.col("_n") == n).select(F.lit(0).cast("long").alias("key"), "bucket", "bits")


def any_of(bitmaps: DataFrame, keys: list) -> DataFrame:
    """OR over keys, as the bitmap of key 0."""
    return bitmaps.where(F.col("key").isin(list(set(keys)))).groupBy("bucket").agg(F.expr("bitmap_or_agg(bits)").alias("bits")).select(F.lit(0).cast("long").alias("key"), "bucket", "bits")


_OPERATIONS = {
    "and": lambda a, b: a & b,
    "or": lambda a, b: a | b,
    "xor": lambda a, b: a ^ b,
    "andnot": lambda a, b: a & ~b,
}


def combine(a: DataFrame, b: DataFrame, operation: str) -> DataFrame:
    """and, or, xor or andnot of two tables of bitmaps, key by key and word by word; empty buckets are left out."""
    if operation not in _OPERATIONS:
        raise ValueError(f"operation must be one of {sorted(_OPERATIONS)}")
    how = {"and": "inner", "andnot": "left"}.get(operation, "full")
    both = a.select("key", "bucket", F.col("bits").alias("x")).join(b.select("key", "bucket", F.col("bits").alias("y")), ["key", "bucket"], how)
    return _wordwise(both, _OPERATIONS[operation])


def complement(a: DataFrame, universe: DataFrame) -> DataFrame:
    """NOT within a universe: a bitmap of key 0 that is the universe of every key."""
    keys = a.select("key").distinct()
    # one row of the universe for each of its buckets, beside every key
    whole = keys.withColumn("_u", F.lit(0).cast("long")).join(universe.select(F.col("key").alias("_u"), "bucket", F.col("bits").alias("x")), "_u").drop("_u")
    return _wordwise(whole.join(a.select("key", "bucket", F.col("bits").alias("y")), ["key", "bucket"], "left"), _OPERATIONS["andnot"])


def _wordwise(both: DataFrame, operation) -> DataFrame:
    width = BUCKET_BITS // 8
    empty = bytes(width)

    def words(column: pa.Array) -> np.ndarray:
        return np.frombuffer(b"".join((x or empty).ljust(width, b"\0") for x in column.to_pylist()), np.uint64).reshape(-1, width // 8)

    def run(batches):
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.slice(at, 256)
                out = operation(words(part.column("x")), words(part.column("y")))
                some = np.flatnonzero(out.any(axis=1))
                rows = pa.array(some)
                yield pa.RecordBatch.from_arrays([part.column("key").take(rows), part.column("bucket").take(rows), pa.array([out[i].tobytes() for i in some], pa.binary())], ["key", "bucket", "bits"])

    return both.select("key", "bucket", "x", "y").mapInArrow(run, SCHEMA)


def _positions_of(bucket: int, at: np.ndarray) -> np.ndarray:
    return at + (bucket - 1) * BUCKET_BITS + 1 if bucket > 0 else bucket * BUCKET_BITS - at


def _set_positions(bucket: int, bits: bytes) -> np.ndarray:
    return _positions_of(bucket, np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")))


def positions(bitmaps: DataFrame) -> DataFrame:
    """(key, position): the set bits, as rows again."""

    def run(batches):
        for b in batches:
            for key, bucket, bits in zip(*(b.column(c).to_pylist() for c in ("key", "bucket", "bits"))):
                at = _set_positions(bucket, bits)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), key)), pa.array(at)], ["key", "position"])

    return bitmaps.select("key", "bucket", "bits").mapInArrow(run, "key long, position long")


def position_sums(bitmaps: DataFrame) -> DataFrame:
    """(key, total): the sum of each key's set-bit positions, taken bucket by bucket without rows for positions."""

    def run(batches):
        for b in batches:
            keys, totals = [], []
            for key, bucket, bits in zip(*(b.column(c).to_pylist() for c in ("key", "bucket", "bits"))):
                keys.append(key)
                totals.append(int(_set_positions(bucket, bits).sum()))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(totals, pa.int64())], ["key", "total"])

    found = bitmaps.select("key", "bucket", "bits").mapInArrow(run, "key long, total long")
    return found.groupBy("key").agg(F.sum("total").alias("total"))


def differences(lists: DataFrame, key: str, bitmaps: DataFrame) -> DataFrame:
    """(key, position, missing_in): members that the lists (key, elements) have and the bitmaps have not, or the other way round.

    Bucket by bucket: where every member of a list has its bit and no more bits are set, both
    hold the same, which built-in functions tell from the bits themselves. The other buckets
    alone are turned to rows. Keys have one list each, buckets one bitmap each.
    """
    members = lists.select(F.col(key).cast("long").alias("key"), F.explode("elements").alias("p")).where("p is not null")
    dealt = members.select("key", F.expr("bitmap_bucket_number(p)").alias("bucket"), F.expr("bitmap_bit_position(p)").alias("_bit")).repartition("key", "bucket")
    listed = dealt.groupBy("key", "bucket").agg(F.collect_set("_bit").alias("at"))
    byte = "ascii(decode(substring(bits, cast(b div 8 as int) + 1, 1), 'ISO-8859-1'))"
    same = f"size(at) = bitmap_count(bits) and forall(at, b -> shiftright({byte}, cast(b % 8 as int)) & 1 = 1)"
    open_ = listed.join(bitmaps.select("key", "bucket", "bits"), ["key", "bucket"], "full").where(f"not coalesce({same}, false)")
    # brings the two rows of a null key together
    rows = open_.groupBy("key", "bucket").agg(F.first("at", True).alias("at"), F.first("bits", True).alias("bits"))

    def run(batches):
        for b in batches:
            for k, bucket, at, bits in zip(*(b.column(c).to_pylist() for c in ("key", "bucket", "at", "bits"))):
                listed, held = _positions_of(bucket, np.array(at or [], np.int64)), _set_positions(bucket, bits or b"")
                less, more = np.setdiff1d(listed, held), np.setdiff1d(held, listed)
                n = len(less) + len(more)
                if n:
                    where = pa.array(["bitmap"] * len(less) + ["list"] * len(more), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array([k] * n, pa.int64()), pa.array(np.append(less, more)), where], ["key", "position", "missing_in"])

    return rows.select("key", "bucket", "at", "bits").mapInArrow(run, "key long, position long, missing_in string")
