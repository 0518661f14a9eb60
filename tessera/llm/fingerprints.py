"""Document fingerprints: threshold-scaled sketches of byte shingles.

A sketch holds every shingle hash below a fixed share of the hash space, so the sketch of a
union is the union of sketches, and the overlap of two sketches estimates containment even
between texts of very unequal length. So that short texts have one too, the FEWEST smallest
hashes are always held: both parts survive merging. Shingles are all runs of SHINGLE bytes
of the UTF-8 text, case and white space included; a shorter text has one shingle, itself,
and an empty one none. A fingerprint is the sorted 32-bit hashes in base64.

Two sketches are compared over the hash range that both cover completely; their likeness is
the mean of the two estimated containments.

Each document's neighbour is the next by doc_id, the first following the last. Documents
are counted, read twice and move once. The first time draws SAMPLE of them, whose order and sizes give
the bounds of ranges; a bound is a document's id and text hash, so many rows of one id are
several ranges. The second time deals documents to ranges, the first of each to the range before
it as well, so a range is one sorted stream and needs no window over the whole table.

Defined cases: a null text counts as empty; two empty texts are alike (1), an empty and
another are not (0); rows with equal doc_id follow each other by text; a null doc_id comes
first; a single document is its own neighbour; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_arrow, mix

SHINGLE = 16
SHARE = 1 / 32  # of the hash space that is held
FEWEST = 64  # smallest hashes that are held in any case
LIMIT = int(SHARE * 2**32)
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
RANGE_BYTES = 4 << 20  # text of one range, about
SAMPLE = 100_000  # documents that bounds are chosen from
LEAST_DRAWN = 2  # of a range, on average: of a sample that is not the whole table no more ranges are made


def _byte_hashes(data: bytes) -> np.ndarray:
    """Sorted distinct 32-bit hashes of the shingles of a text."""
    if not data:
        return np.zeros(0, np.uint32)
    if len(data) < SHINGLE:
        data = data + b"\x00" * (SHINGLE - len(data))
    lanes = np.lib.stride_tricks.sliding_window_view(np.frombuffer(data, np.uint8), 8)
    lane = np.ascontiguousarray(lanes).view("<u8").ravel()
    n = len(data) - SHINGLE + 1
    h = mix(mix(lane[:n], 1) ^ (lane[8 : 8 + n] * np.uint64(0x9FB21C651E98DF25)), 2)
    return (h >> np.uint64(32)).astype(np.uint32)


def sketch(data: bytes) -> np.ndarray:
    """Sorted hashes: all below LIMIT, and the FEWEST smallest."""
    h = _byte_hashes(data)
    low = np.unique(h[h < LIMIT])
    if len(low) < FEWEST:
        k = min(len(h), 4 * FEWEST)
        while True:
            low = np.unique(np.partition(h, k - 1)[:k]) if k < len(h) else np.unique(h)
            if len(low) >= FEWEST or k >= len(h):
                break
            k = min(len(h), 4 * k)
        low = low[: max(FEWEST, int(np.searchsorted(low, LIMIT)))]
    return low


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of both shingle sets together."""
    u = np.union1d(a, b)
    return u[: max(FEWEST, int(np.searchsorted(u, LIMIT)))]


def _cover(s: np.ndarray) -> int:
    """The hash up to which a sketch is complete: everything, if it has fewer than FEWEST hashes."""
    return 2**32 if len(s) < FEWEST else max(LIMIT, int(s[-1]) + 1)


def containments(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """Estimated shares of a's shingles in b and of b's in a."""
    if not len(a) or not len(b):
        return (1.0, 1.0) if len(a) == len(b) else (0.0, 0.0)
    end = min(_cover(a), _cover(b))
    x, y = a[: np.searchsorted(a, end)], b[: np.searchsorted(b, end)]
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(len(x), 1), both / max(len(y), 1)


def compare(a: np.ndarray, b: np.ndarray) -> float:
    """Likeness in 0 to 1: the mean of both containments; equal sketches have 1, unrelated ones about 0."""
    return sum(containments(a, b)) / 2


def encode(s: np.ndarray) -> str:
    return base64.b64encode(s.astype("<u4").tobytes()).decode()


def decode(s: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(s), "<u4")


def _order(doc_id: int | None, h: int) -> tuple:
    return doc_id is not None, doc_id or 0, h


def _bounds(rows: DataFrame) -> list[tuple[int | None, int]]:
    """Ascending (doc_id, h) that ranges of rows(doc_id, h, text) start with: rows of about RANGE_BYTES lie between two; the first is the least row drawn."""
    part = min(1.0, SAMPLE / max(rows.count(), 1))  # the share of rows that is drawn; a count reads footers alone
    drawn = rows.select("doc_id", "h", F.octet_length("text").alias("bytes")).where(F.rand(7) < part).collect()  # about SAMPLE rows
    if not drawn:  # an empty table
        return []
    size = sum(r["bytes"] for r in drawn) / part
    count = int(max(1, min(size // RANGE_BYTES + 1, len(drawn) // LEAST_DRAWN)))
    held = sorted((_order(r["doc_id"], r["h"]), r["bytes"]) for r in drawn)
    bounds, filled = [held[0][0]], 0
    for order, n in held:
        if filled >= size * part / count and order > bounds[-1]:
            bounds.append(order)
            filled = 0
        filled += n
    return [(i if known else None, h) for known, i, h in bounds]


def _placed(rows: DataFrame, bounds: list[tuple[int | None, int]]) -> DataFrame:
    """rows(doc_id, h, text) with part, and last = 1 for copies of a range's first row in the range before it.

    What precedes the first bound is of the first range. Which of these rows is the least is not known here: all of
    them, few as the least of SAMPLE rows drawn is their end, are copied to the last range.
    """
    spark, n = rows.sparkSession, len(bounds)
    keys = [(i is not None, i or 0, h) for i, h in bounds]
    listed = "array<struct<k: boolean, i: bigint, h: bigint>>"
    table = spark.createDataFrame([(keys,)], f"_bounds {listed}")  # one row, of SAMPLE / LEAST_DRAWN bounds at most
    out = rows.withColumn("_bounds", table.scalar()).withColumn("_o", F.struct(F.col("doc_id").isNotNull().alias("k"), F.coalesce("doc_id", F.lit(0)).alias("i"), F.col("h"))).withColumn("part", F.lit(0))
    for step in (1 << b for b in range(max(n - 1, 0).bit_length() - 1, -1, -1)):  # bisection, one look-up a step
        out = out.withColumn("part", F.when(F.coalesce(F.get("_bounds", F.col("part") + step) <= F.col("_o"), F.lit(False)), F.col("part") + step).otherwise(F.col("part")))
    here = F.struct(F.col("part"), F.lit(0).alias("last"))
    before = F.struct(F.pmod(F.col("part") - 1, F.lit(n)).alias("part"), F.lit(1).alias("last"))
    first = (F.get("_bounds", F.col("part")) == F.col("_o")) | ((F.col("part") == 0) & (F.col("_o") < F.get("_bounds", F.lit(0))))
    places = F.when(first, F.array(here, before)).otherwise(F.array(here))
    return out.select("doc_id", "h", "text", F.inline(places))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every document; no shuffle."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([encode(sketch(t or b"")) for t in b.column("text").cast(pa.large_binary()).to_pylist()], pa.string())], ["doc_id", "fingerprint"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, fingerprint string")


def with_edits(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint beside that of its edited text and its neighbour's.

    (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).
    The edited text has its last floor(n_chars / 4) code points replaced by the first as many
    of the next document, or all of them if it has fewer.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    bounds = _bounds(rows)
    if not bounds:
        return docs.sparkSession.createDataFrame([], SCHEMA)
    spread = _placed(rows, bounds).repartition(len(bounds), "part").sortWithinPartitions("part", "last", F.asc_nulls_first("doc_id"), "h").drop("h")

    def run(batches):
        held = None  # the row whose neighbour has not come yet: id, text, sketch, part

        def finish(row, after):
            doc, text, own, _ = row
            k = len(text) // 4
            edited = (text[: len(text) - k] + after[1][:k]).encode("utf-8", "surrogatepass")
            other = sketch(edited)
            return doc, len(text), hashlib.sha256(edited).hexdigest(), encode(own), encode(other), compare(own, other), compare(own, after[2])

        for b in batches:
            for at in range(0, len(b), 256):
                piece = b.slice(at, 256)
                out = []
                for doc, text, part, last in zip(*(piece.column(c).to_pylist() for c in ("doc_id", "text", "part", "last"))):
                    if last and held is None:
                        continue  # a repetition of the row that closed the range
                    row = (doc, text, sketch(text.encode("utf-8", "surrogatepass")), part)
                    if held is not None and held[3] == part:
                        out.append(finish(held, row))
                    held = None if last else row
                columns = [list(c) for c in zip(*out)] or [[]] * 7
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return map_arrow(spread, run, SCHEMA)
