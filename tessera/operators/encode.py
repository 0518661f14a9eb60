"""Run-length and Huffman encodings, and aggregates over encoded data."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.ranges import bisect, sampled_bounds

BLOCK = 4096  # values in a packed block, at most


def rle_encode(df: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """(group, run, value, run_len): runs of equal values within each group, in order.

    Gaps and islands: one shuffle on the group serves both windows and the aggregate.
    """
    w = W.partitionBy(group).orderBy(order)
    new = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    runs = df.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return runs.groupBy(group, "run").agg(F.first(value).alias("value"), F.count("*").alias("run_len")).select(group, "run", "value", "run_len")


def rle_sorted(df: DataFrame, value: str) -> DataFrame:
    """Runs of a column sorted by itself: each value is one run, so this is one aggregate."""
    return df.groupBy(F.col(value).alias("value")).agg(F.count("*").alias("run_len"))


def rle_directory(df: DataFrame, key: str, keys_in_part: int = 100_000, most: int = 1024) -> DataFrame:
    """(key, length, row_id): where the run of each key starts in the table sorted by key, nulls first.

    Running sums are made in two steps over ranges of keys with sampled bounds, so no task
    sees all keys however they cluster: within each range, plus the offset of the range.
    """
    sizes = df.groupBy(key).agg(F.count("*").alias("length"))
    bounds = sampled_bounds(sizes, key, min(most, sizes.count() // keys_in_part + 1))
    listed = F.array(*[F.lit(x) for x in bounds]) if bounds else F.array(F.lit(None).cast(sizes.schema[key].dataType))
    ranged = bisect(sizes, key, listed, len(bounds), "_b")
    inner = F.sum("length").over(W.partitionBy("_b").orderBy(F.asc_nulls_first(key)).rowsBetween(W.unboundedPreceding, 0)) - F.col("length")
    per = ranged.groupBy("_b").agg(F.sum("length").alias("_t"))
    # at most `most` rows: the one window without a partition
    before = per.select("_b", (F.sum("_t").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, 0)) - F.col("_t")).alias("_o"))
    return ranged.withColumn("_i", inner).join(F.broadcast(before), "_b").select(key, "length", (F.col("_i") + F.col("_o")).alias("row_id"))


def sum_plain(df: DataFrame, value: str) -> DataFrame:
    return df.agg(F.sum(value).alias("total"))


def sum_over_rle(runs: DataFrame) -> DataFrame:
    """The sum of the decoded column, without decoding."""
    return runs.agg(F.sum(F.col("value") * F.col("run_len")).alias("total"))


def symbol_frequencies(df: DataFrame, value: str) -> DataFrame:
    return df.groupBy(F.col(value).alias("symbol")).agg(F.count("*").alias("freq"))


def huffman_lengths(symbol: np.ndarray, freq: np.ndarray) -> np.ndarray:
    """Code length of each of some distinct symbols with counts of at least 1. Ties go to the smaller count, then the smallest symbol below a node; one symbol gets 1 bit.

    All nodes of one count are merged in a step: a merged node counts more than both its
    parts, so the nodes of the least count are complete when it is their turn.
    """
    n = len(symbol)
    if n < 2:
        return np.ones(n, np.int64)
    order = np.lexsort((symbol, freq))
    least = np.empty(2 * n - 1, np.int64)  # the smallest symbol below each node: leaves in order, then merged nodes
    least[:n] = symbol[order]
    counts, edge = np.unique(freq[order], return_index=True)
    edge = np.append(edge, n).tolist()
    waiting = {w: [np.arange(lo, hi)] for w, lo, hi in zip(counts.tolist(), edge, edge[1:])}
    heap, steps, made, odd = sorted(waiting), [], n, None

    def merge(a: np.ndarray, b: np.ndarray, w: int) -> None:
        nonlocal made
        to = np.arange(made, made + len(a))
        least[to] = np.minimum(least[a], least[b])
        steps.append((a, b, to))
        made += len(a)
        if w not in waiting:
            waiting[w] = []
            heapq.heappush(heap, w)
        waiting[w].append(to)

    while heap:
        w = heapq.heappop(heap)
        nodes = np.concatenate(waiting.pop(w))
        nodes = nodes[np.argsort(least[nodes])]
        if odd is not None:  # one node of a smaller count is left
            merge(odd[0], nodes[:1], odd[1] + w)
            nodes, odd = nodes[1:], None
        even = len(nodes) // 2 * 2
        if even:
            merge(nodes[:even:2], nodes[1:even:2], 2 * w)
        if even < len(nodes):
            odd = nodes[even:], w
    depth = np.zeros(2 * n - 1, np.int64)
    for a, b, to in reversed(steps):
        depth[a] = depth[b] = depth[to] + 1
    out = np.empty(n, np.int64)
    out[order] = depth[:n]
    return out


def _lengths(df: DataFrame, value: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, their counts and code lengths, by length and symbol. The table of distinct symbols, 16 bytes each, is all that reaches the driver."""
    rows = symbol_frequencies(df.where(F.col(value).isNotNull()), value).select(F.col("symbol").cast("long"), "freq").toArrow()
    symbol, freq = (rows.column(c).to_numpy() for c in ("symbol", "freq"))
    length = huffman_lengths(symbol, freq)
    order = np.lexsort((symbol, length))
    return symbol[order], freq[order], length[order]


def huffman_code_lengths(df: DataFrame, value: str) -> DataFrame:
    """(symbol, freq, length): what huffman_codes gives, without the codes."""
    symbol, freq, length = _lengths(df, value)
    return _rows(df, {"symbol": pa.array(symbol), "freq": pa.array(freq), "length": pa.array(length.astype(np.int32))})


def huffman_codes(df: DataFrame, value: str) -> DataFrame:
    """(symbol, freq, length, code): canonical codes from the column's symbol counts."""
    symbol, freq, length = _lengths(df, value)
    code, last, codes = 0, 0, []
    for n in length.tolist():
        code <<= n - last
        codes.append(format(code, f"0{n}b"))
        code, last = code + 1, n
    return _rows(df, {"symbol": pa.array(symbol), "freq": pa.array(freq), "length": pa.array(length.astype(np.int32)), "code": pa.array(codes, pa.string())})


def _rows(df: DataFrame, columns: dict[str, pa.Array]) -> DataFrame:
    kinds = {"symbol": "long", "freq": "long", "length": "int", "code": "string"}
    return df.sparkSession.createDataFrame(pa.table(columns), ", ".join(f"{c} {kinds[c]}" for c in columns))


def huffman_size_estimate(codes: DataFrame, width: int = 16) -> DataFrame:
    """Bits of the column at a fixed width, encoded, and encoded with code lengths rounded up to a multiple of four."""
    rounded = F.ceil(F.col("length") / 4) * 4
    return codes.agg(
        F.sum(F.col("freq") * width).alias("uncompressed_bits"),
        F.sum(F.col("freq") * F.col("length")).alias("bits"),
        F.sum(F.col("freq") * rounded).alias("bits_rounded"),
        F.sum("freq").alias("symbols"),
        F.count("*").alias("distinct_symbols"),
        F.max("length").cast("long").alias("longest"),
    )


def huffman_length_histogram(codes: DataFrame) -> DataFrame:
    return codes.groupBy(F.col("length").cast("long").alias("length")).agg(F.count("*").alias("n"))


class _Table:
    """A canonical code as arrays: by symbol for encoding, by left-aligned code for decoding."""

    PEEK = 56  # bits looked at for one symbol

    def __init__(self, rows: list | pa.Table) -> None:
        found = rows.select(["symbol", "length", "code"]) if isinstance(rows, pa.Table) else pa.table({c: [r[c] for r in rows] for c in ("symbol", "length", "code")})
        symbol, length = (np.asarray(found.column(c), np.int64) for c in ("symbol", "length"))
        order = np.lexsort((symbol, length))
        self.symbol, self.length = symbol[order], length[order]
        if len(order) and self.length[-1] > self.PEEK:
            raise ValueError(f"codes of more than {self.PEEK} bits")
        self.code = np.array([int(x, 2) for x in found.column("code").to_pylist()], np.uint64)[order]
        self.aligned = self.code << (self.PEEK - self.length).astype(np.uint64)  # ascending, as codes are canonical
        self.by_symbol = np.argsort(self.symbol)

    def pack(self, values: np.ndarray) -> tuple[bytes, int]:
        """Codes of the values one after another, most significant bit first, and their number of bits."""
        at = self.by_symbol[np.searchsorted(self.symbol, values, sorter=self.by_symbol)]
        n = self.length[at]
        within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        bits = (np.repeat(self.code[at], n) >> (np.repeat(n, n) - 1 - within).astype(np.uint64)) & np.uint64(1)
        return np.packbits(bits.astype(np.uint8)).tobytes(), int(n.sum())

    def unpack(self, blocks: list[bytes], counts: list[int]) -> list[np.ndarray]:
        """The values of each block; all blocks are decoded side by side, a symbol of each in a step."""
        n = np.array(counts, np.int64)
        out = np.zeros((len(blocks), int(n.max(initial=0))), np.int64)
        data = np.frombuffer(b"".join(x + bytes(8) for x in blocks), np.uint8).astype(np.uint64)
        size = np.array([len(x) + 8 for x in blocks], np.int64)
        at = 8 * (np.cumsum(size) - size)
        for k in range(out.shape[1]):
            live = np.flatnonzero(n > k)
            bit = at[live]
            word = np.zeros(len(live), np.uint64)
            for j in range(8):
                word = word << np.uint64(8) | data[(bit >> 3) + j]
            peek = word << (bit & 7).astype(np.uint64) >> np.uint64(64 - self.PEEK)
            found = np.searchsorted(self.aligned, peek, side="right") - 1
            out[live, k] = self.symbol[found]
            at[live] += self.length[found]
        return [out[i, :c] for i, c in enumerate(n)]


_BLOCKS = "first long, n int, n_bits long, bits binary"


def huffman_encode(df: DataFrame, codes: DataFrame, group: str, order: str, value: str, block: int = BLOCK) -> DataFrame:
    """(group, first, n, n_bits, bits): the values of each group in order, in packed blocks of at most `block` values; first is the order of a block's first value.

    Rows are dealt by ranges of group and order, so a large group is several tasks; a block
    never spans two. order must be a long, distinct within a group; rows whose value is null or
    without a code are left out.
    """
    kind = df.schema[group].dataType.simpleString()
    table = df.sparkSession.sparkContext.broadcast(_Table(codes.toArrow()))  # the table of distinct symbols
    rows = df.select(F.col(group).alias("g"), F.col(order).cast("long").alias("o"), F.col(value).cast("long").alias("v")).join(F.broadcast(codes.select(F.col("symbol").alias("v"))), "v", "left_semi")
    dealt = rows.repartitionByRange("g", "o").sortWithinPartitions("g", "o", "v").select("g", "o", "v")

    def run(batches):
        for b in batches:
            g = b.column("g")
            new = np.ones(len(b), bool)
            if len(b) > 1:
                new[1:] = pc.fill_null(pc.not_equal(g[1:], g[:-1]), False).to_numpy(zero_copy_only=False) | (pc.is_null(g[1:]).to_numpy(zero_copy_only=False) != pc.is_null(g[:-1]).to_numpy(zero_copy_only=False))
            edge = np.flatnonzero(new).tolist() + [len(b)]
            cuts = [(lo, min(lo + block, hi)) for a, hi in zip(edge, edge[1:]) for lo in range(a, hi, block)]
            o, v = b.column("o").to_numpy(zero_copy_only=False), b.column("v").to_numpy()
            packed = [table.value.pack(v[lo:hi]) for lo, hi in cuts]
            starts = pa.array([lo for lo, _ in cuts], pa.int64())
            yield pa.RecordBatch.from_arrays([g.take(starts), pa.array(o[[lo for lo, _ in cuts]] if cuts else [], pa.int64()), pa.array([hi - lo for lo, hi in cuts], pa.int32()), pa.array([x[1] for x in packed], pa.int64()), pa.array([x[0] for x in packed], pa.binary())], [group, "first", "n", "n_bits", "bits"])

    return dealt.mapInArrow(run, f"`{group}` {kind}, {_BLOCKS}")


def _decoded(encoded: DataFrame, codes: DataFrame, emit, schema: str) -> DataFrame:
    table = encoded.sparkSession.sparkContext.broadcast(_Table(codes.toArrow()))  # the table of distinct symbols

    def run(batches):
        for b in batches:
            for at in range(0, len(b), 1024):
                part = b.slice(at, 1024)
                yield emit(part, table.value.unpack(part.column("bits").to_pylist(), part.column("n").to_pylist()))

    return encoded.mapInArrow(run, schema)


def huffman_decode(encoded: DataFrame, codes: DataFrame, group: str) -> DataFrame:
    """(group, pos, value): the values of each group, numbered in order from 0."""
    kind = encoded.schema[group].dataType.simpleString()
    before = F.sum("n").over(W.partitionBy(group).orderBy("first", "bits").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")

    def emit(part, values):
        sizes = [len(v) for v in values]
        row = np.repeat(np.arange(len(values)), sizes)
        pos = part.column("_at").to_numpy()[row] + np.concatenate([*(np.arange(n) for n in sizes), np.zeros(0, np.int64)]).astype(np.int64)
        return pa.RecordBatch.from_arrays([part.column(group).take(pa.array(row)), pa.array(pos), pa.array(np.concatenate([*values, np.zeros(0, np.int64)]))], [group, "pos", "value"])

    return _decoded(encoded.withColumn("_at", before.cast("long")), codes, emit, f"`{group}` {kind}, pos long, value long")


def sum_over_huffman(encoded: DataFrame, codes: DataFrame) -> DataFrame:
    """The sum of the decoded column; blocks are decoded and added up where they lie."""

    def emit(part, values):
        return pa.RecordBatch.from_arrays([pa.array([int(v.sum()) for v in values], pa.int64())], ["total"])

    return _decoded(encoded.select("n", "bits"), codes, emit, "total long").agg(F.sum("total").alias("total"))


def huffman_bytes(encoded: DataFrame, group: str, width: int = 2) -> DataFrame:
    """(group, raw_bytes, encoded_bytes): each group's values at a fixed width, and as one bit string with a closing byte."""
    return encoded.groupBy(group).agg((F.sum("n") * width).alias("raw_bytes"), (F.floor(F.sum("n_bits") / 8) + 1).alias("encoded_bytes"))


def postings_size_report(dt: DataFrame, key: str) -> DataFrame:
    """Bytes of each key's postings as 2-byte and 4-byte entries, and as bitmap buckets of 4096 bytes."""
    other = "doc" if key == "term" else "term"
    buckets = F.countDistinct(F.floor(F.col(other) / 32768))
    return dt.groupBy(key).agg(F.count("*").alias("n"), buckets.alias("_b")).select(key, "n", (F.col("n") * 2).alias("bytes2"), (F.col("n") * 4).alias("bytes4"), (F.col("_b") * 4096).alias("bitmap_bytes"))
