"""What several operators share: checkpoints, stable ids and vectorised word arithmetic on Arrow text."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import itertools
import string
import tempfile
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.shared import checkpoint as checkpoint
from tessera.shared import remove as remove
from tessera.shared import shared_folder as shared_folder
from tessera.shared import stored as stored

_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)  # a random odd 64-bit number for each byte
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_STEP = 4096
_PLAIN = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))
CHUNK_BYTES = 1 << 20  # text that one step of a vectorised operator holds


def bitmap(df: DataFrame, column: str, count: int, most: int) -> np.ndarray:
    """Bits of a long column's values at their low bits; about 16 for each of count values, and at most `most`."""
    bits = min(most, max(1 << 15, 1 << (16 * count).bit_length()))
    at = F.col(column).bitwiseAND(F.lit(bits - 1))
    rows = df.groupBy(F.shiftright(at, 15).alias("block")).agg(F.expr(f"bitmap_construct_agg(cast({column} & {(1 << 15) - 1} as bigint))").alias("bits")).toLocalIterator()
    out = np.zeros(bits // 8, np.uint8)
    for r in rows:  # bits / 2**15 rows of 4 kB at most
        out[r["block"] << 12 : (r["block"] + 1) << 12] = np.frombuffer(r["bits"], np.uint8)
    return out


def in_bitmap(held: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = values & np.int64(8 * len(held) - 1)
    return (held[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser; another salt gives an independent hash."""
    x = x + np.uint64((salt * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    small, big = np.ones(_STEP, np.uint64), np.ones(n // _STEP + 1, np.uint64)
    small[1:] = np.uint64(base)
    step = pow(base, _STEP, 2**64)
    big[1:] = np.uint64(step)
    return (np.multiply.accumulate(big)[:, None] * np.multiply.accumulate(small)[None, :]).ravel()[:n]


class Spans:
    """Hashes of arbitrary byte ranges of one buffer, each in constant time.

    A polynomial hash modulo 2**64 over random byte values: prefix sums are made once;
    hash(s, e) is the difference of two of them, shifted to position 0 and mixed. Such hashes
    have known collisions among texts of 1,024 bytes and more, so ranges of LONG bytes or more
    are hashed one by one with XXH3 instead.
    """

    LONG = 512

    _cache: tuple[np.ndarray, np.ndarray] | None = None

    def __init__(self, data: np.ndarray) -> None:
        n = len(data) + 1
        if Spans._cache is not None and len(Spans._cache[0]) >= n:
            up, self._down = Spans._cache
        else:
            size = max(n, CHUNK_BYTES + CHUNK_BYTES // 4)
            up, self._down = _powers(_BASE, size), _powers(pow(_BASE, -1, 2**64), size)
            if size < 2 * CHUNK_BYTES:  # those of a very long text go with it
                Spans._cache = up, self._down
        self._data = data
        self._sum = np.zeros(n, np.uint64)
        np.cumsum(_BYTE[data] * up[: n - 1], out=self._sum[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = mix((self._sum[end] - self._sum[start]) * self._down[start] + (end - start).astype(np.uint64))
        long = np.flatnonzero(end - start >= self.LONG)
        if len(long):
            raw = memoryview(self._data)
            h[long] = [xxhash.xxh3_64_intdigest(raw[s:e]) for s, e in zip(start[long].tolist(), end[long].tolist())]
        return h


class Words:
    """Words (runs of bytes other than 0x20 and 0x09-0x0D) of a chunk of documents, as offset arrays.

    lower folds A-Z; plain also takes ASCII punctuation for white space.
    """

    def __init__(self, texts: pa.Array, lower: bool = False, plain: bool = False) -> None:
        words: list[bytes] = []
        ends = [0]
        for text in texts.cast(pa.large_binary()).to_pylist():
            text = (text or b"").lower() if lower else text or b""  # of bytes: changes ASCII letters only
            words += (text.translate(_PLAIN) if plain else text).split()  # of bytes: at ASCII white space only
            ends.append(len(words))
        self.doc = np.array(ends)  # word offsets of each document
        self.data = np.frombuffer(b" ".join(words) + b" ", np.uint8)  # so any run of words is one byte range
        self.end = np.flatnonzero(self.data == 32) if words else np.zeros(0, np.int64)
        self.start = np.append(0, self.end[:-1] + 1) if words else self.end
        self.owner = np.repeat(np.arange(len(ends) - 1), np.diff(self.doc))

    def __len__(self) -> int:
        return len(self.start)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last word index of all k-word runs that lie within one document."""
        n = len(self)
        if n < k:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        first = np.arange(n - k + 1)
        first = first[self.owner[first] == self.owner[first + k - 1]]
        return first, first + k - 1

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """As grams, and for documents with 1 to k-1 words the whole sequence."""
        n = np.diff(self.doc)
        count = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
        doc = np.repeat(np.arange(len(n)), count)
        first = self.doc[doc] + np.arange(len(doc)) - (np.cumsum(count) - count)[doc]
        return first, first + np.minimum(k, n[doc]) - 1


def chunks(batches, column: str, limit: int = CHUNK_BYTES):
    """Record batches cut so that the text column holds about limit bytes; one longer text is a chunk of its own."""
    for batch in batches:
        sizes = np.diff(np.frombuffer(batch.column(column).cast(pa.large_binary()).buffers()[1], np.int64, len(batch) + 1, batch.column(column).cast(pa.large_binary()).offset * 8)) if len(batch) else []
        at, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > limit:
                yield batch.slice(at, i - at)
                at, held = i, 0
            held += int(n)
        if at < len(batch):
            yield batch.slice(at)


def whole(batches, name: str):
    """Tables of batches sorted by a column, cut so that rows of one value are never parted."""
    held: pa.Table | None = None  # rows of the last value, which may go on in the next batch
    for b in itertools.chain(batches, [None]):
        if b is not None and not len(b):
            continue
        if b is not None:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            key = held.column(name)
            if key[0].as_py() == key[-1].as_py():
                continue
            cut = int(np.searchsorted(key.to_numpy(), key[-1].as_py()))
            now, held = held.slice(0, cut), held.slice(cut).combine_chunks()
        else:
            now = held
        if now is not None and len(now):
            yield now


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once an application, so that their Python workers can import it."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = Path(__file__).resolve().parents[1]
        at = Path(tempfile.mkdtemp(prefix="ship")) / f"{root.name}.zip"
        with zipfile.ZipFile(at, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        sc.addPyFile(str(at))
        _shipped.add(sc.applicationId)


KEPT: dict[str, dict] = {}  # what operators keep in this Python worker for its next task, by module


def keep(owner: str) -> dict:
    """The dictionary that a module keeps between tasks of a worker."""
    return KEPT.setdefault(owner, {})


_LAST: list[str] = []  # the module that this Python worker served last


def _alone(owner: str) -> None:
    """Drop what other modules keep, and give freed memory back: a worker that serves several stages holds what one needs."""
    if _LAST == [owner]:
        return
    for other in [k for k in KEPT if k != owner]:
        KEPT.pop(other).clear()
    if _LAST:
        Spans._cache = None
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # only where the C library can trim
            ctypes.CDLL(None).malloc_trim(0)
    _LAST[:] = [owner]


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """mapInArrow with this package importable on the executors."""
    ship(df.sparkSession)
    owner = run.__module__

    def alone(batches):
        _alone(owner)
        yield from run(batches)

    return df.mapInArrow(alone, schema)
