"""Language identification by error-correcting output codes.

Each language has a codeword of plus and minus bits. One binary classifier for each bit
weighs hashed byte trigrams by the log-ratio of their frequencies in the languages with
plus and with minus, every language counting alike. Decoding is loss-weighted: a text
gets the language whose codeword has the least total logistic loss under the bits'
margins; a small gap to the next codeword flags the text as ambiguous.

Learning counts trigrams of at most SAMPLE documents for each language, picked by a hash
of doc_id and text among those with a language whose crc32(doc_id) mod 3 is not 1. Every document
is then predicted, over its whole text.

Defined cases: a text that is null or has no letter is `und` with score 0; without
training rows every text is `und`; with one language all others texts get it; a null
doc_id is predicted and counts as not held out; repeated rows are each returned; an
empty table gives no rows; other columns are ignored. Texts are weighed in parts of a million code
points, so a very long one costs little more than itself in memory.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import chunks, map_arrow

SAMPLE = 2_000  # training documents of each language, at most (in expectation; half as many again is the hard bound)
BUCKETS = 1 << 14
GAIN = 40  # trigrams after which more text no longer raises a margin
AMBIGUOUS = 0.75  # scores below this are flagged
_CHUNK = 1 << 20
STEP = 1 << 18  # trigrams that are weighed at a time
_FOLD = bytes(32 if c < 128 and not chr(c).isalpha() else c for c in range(256))


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def codewords(n: int) -> np.ndarray:
    """n distinct rows of +1 and -1: all ways to part up to 6 languages in two, else random balanced columns."""
    if n < 2:
        return np.ones((n, 1))
    if n <= 6:
        splits = [np.array([1, *s]) for s in itertools.product((1, -1), repeat=n - 1)]
        return np.stack([s for s in splits if (s < 0).any()], axis=1).astype(float)
    rng = np.random.default_rng(3)
    bits = 12 * math.ceil(math.log2(n))
    half = np.where(np.arange(n) < n // 2, 1.0, -1.0)
    while True:
        code = np.stack([rng.permutation(half) for _ in range(bits)], axis=1)
        if len(np.unique(code, axis=0)) == n:
            return code


def segments(texts: list[str | None]):
    """Lists of parts of texts, about _CHUNK code points in all, with the text that each is of; a longer text's parts overlap by a code point."""
    owner, parts, held = [], [], 0
    for i, t in enumerate(texts):
        t = t or ""
        for at in range(0, max(len(t), 1), _CHUNK):
            part = t[max(at - 1, 0) : at + _CHUNK]
            if held and held + len(part) > _CHUNK:
                yield np.array(owner), parts
                owner, parts, held = [], [], 0
            owner.append(i)
            parts.append(part)
            held += len(part)
    if parts:
        yield np.array(owner), parts


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every byte trigram of the lower-cased texts, and how many each text has."""
    data = [b" " + t.lower().encode("utf-8", "replace").translate(_FOLD) + b" " if t else b"" for t in texts]
    size = np.array([max(len(d) - 2, 0) for d in data], np.int64)
    flat = np.frombuffer(b"".join(data), np.uint8).astype(np.uint32)
    if len(flat) < 3:
        return np.zeros(0, np.int64), size
    code = flat[:-2] | flat[1:-1] << np.uint32(8) | flat[2:] << np.uint32(16)
    length = np.array([len(d) for d in data], np.int64)
    keep = np.ones(len(flat), bool)
    ends = np.cumsum(length)[length > 0]
    keep[ends - 1] = keep[ends - 2] = False  # trigrams that run into the next text
    code = code[keep[: len(code)]]
    return ((code * np.uint32(2654435761)) >> np.uint32(18)).astype(np.int64), size


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    weights: np.ndarray  # BUCKETS x bits
    codes: np.ndarray  # languages x bits

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and gap to the next language of each text; texts must have a letter."""
        total, size = np.zeros((len(texts), self.weights.shape[1])), np.zeros(len(texts), np.int64)
        for owner, parts in segments(texts):
            grams, n = trigrams(parts)
            at = np.cumsum(n) - n
            for k in range(0, len(grams), STEP):  # bounded whatever the number of bits
                some = np.flatnonzero((n > 0) & (at < k + STEP) & (at + n > k))
                if len(some):
                    np.add.at(total, owner[some], np.add.reduceat(self.weights[grams[k : k + STEP]], np.maximum(at[some] - k, 0), axis=0))
            np.add.at(size, owner, n)
        margin = total / np.maximum(size, 1)[:, None] * np.minimum(size, GAIN)[:, None]
        loss = np.logaddexp(0, -margin[:, None, :] * self.codes[None]).sum(axis=2)
        order = np.argsort(loss, axis=1, kind="stable")
        best = order[:, 0]
        close = np.exp(loss.min(axis=1, keepdims=True) - loss)
        p = close[np.arange(len(texts)), best] / close.sum(axis=1)
        gap = loss[np.arange(len(texts)), order[:, 1]] - loss.min(axis=1) if loss.shape[1] > 1 else np.full(len(texts), np.inf)
        return [self.languages[i] for i in best], p, gap


def learn(docs: DataFrame) -> Model | None:
    """A model from the documents with a language that are not held out; None if there are none."""
    train = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string")).where("lang is not null and text is not null").where(~held_out())
    sizes = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    if not sizes:
        return None
    share = F.create_map(*itertools.chain.from_iterable((F.lit(k), F.lit(min(1 << 20, int((1 << 20) * SAMPLE / n) + 1))) for k, n in sizes.items()))
    train = train.withColumn("_h", F.xxhash64("doc_id", "lang", "text"))
    # only their hashes meet in one task; texts are read where they lie
    ids = train.where(F.pmod("_h", F.lit(1 << 20)) < share[F.col("lang")]).select("_h").distinct().limit(3 * SAMPLE * len(sizes) // 2)
    picked = train.join(F.broadcast(ids), "_h", "left_semi").dropDuplicates(["_h"])

    def count(batches):
        for b in batches:
            for part in chunks([b], "text", _CHUNK):
                langs = np.array(part.column("lang").to_pylist(), object)
                for rows, texts in segments(part.column("text").to_pylist()):
                    grams, size = trigrams(texts)
                    owner = np.repeat(langs[rows], size)
                    for lang in set(langs[rows]):
                        n = np.bincount(grams[owner == lang], minlength=BUCKETS)
                        at = np.flatnonzero(n)
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n[at])], ["lang", "bucket", "n"])

    # BUCKETS rows for each language at most
    rows = map_arrow(picked.select("text", "lang"), count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = tuple(sorted(rows["lang"].unique()))
    if not languages:
        return None
    counts = np.zeros((len(languages), BUCKETS))
    counts[[languages.index(x) for x in rows["lang"]], rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    rate = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    codes = codewords(len(languages))
    eps = 0.5 / BUCKETS / 10

    def side(bit: np.ndarray, sign: int) -> np.ndarray:
        return rate[bit == sign].mean(axis=0) + eps if (bit == sign).any() else np.full(BUCKETS, 1 / BUCKETS)

    weights = np.stack([np.log(side(b, 1)) - np.log(side(b, -1)) for b in codes.T], axis=1)
    return Model(languages, weights.astype(np.float32), codes)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, gap, ambiguous) for every document."""

    def run(batches):
        for b in batches:
            for part in chunks([b], "text", _CHUNK):
                lang, score, gap = ["und"] * len(part), np.zeros(len(part)), np.zeros(len(part))
                at = [i for i, ok in enumerate(part.column("letters").to_pylist()) if ok]
                if model is not None and at:
                    texts = part.column("text").to_pylist()
                    found, p, g = model.predict([texts[i] for i in at])
                    for i, x in zip(at, found):
                        lang[i] = x
                    score[at], gap[at] = p, g
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lang), pa.array(score), pa.array(gap)], ["doc_id", "lang_pred", "score", "gap"])

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    found = map_arrow(texts, run, "doc_id long, lang_pred string, score double, gap double")
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "gap", ((F.col("score") < AMBIGUOUS) & (F.col("lang_pred") != "und")).alias("ambiguous"))
