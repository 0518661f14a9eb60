"""Removal of repeated passages with phrase automata.

A window is a run of `size` consecutive words. Words are removed that lie in a window whose
words also start in a document with a smaller doc_id. Three passes, each linear in the text:

1. Anchors. Each window has one anchor, the run of ANCHOR words in it with the smallest
   hash, so equal windows have equal anchors; about one position in five is one. Anchor
   hashes that two documents have are kept in a bitmap, sized by their count up to
   MAX_BITS: a broadcast of proven bound. A full bitmap lets more windows into pass 2,
   which costs time and changes no result.
2. Shards. Consecutive windows with one recurring anchor are a unit: their words, where they
   start and in which document. Units are dealt by anchor, so all places where a phrase can
   occur meet in one shard, with their words.
3. Automata. In a shard the windows that recur in several documents are its phrases. They
   are compiled into Aho-Corasick automata over word numbers, SHARD_PHRASES in each, and all
   units of the shard that can hold one are streamed through. Where a phrase occurs, and which
   document has it first, is what the automata report; words they cover are removed.

Hashes only propose: which windows are looked at, what meets in a shard, which windows become
phrases. Two windows count as equal if their words are: the automata, or a comparison of the
units' text, decide. A proposed window that no automaton reports shares a hash with other words
and becomes a phrase of its own, so no collision adds or loses a match.

Hot anchors. An anchor in more than HOT units (and in more than one of MAX_HOT of them all, so
there are at most MAX_HOT such anchors to broadcast) is not a shard: each of its windows is a
unit of its own, dealt by a hash of its words. Of equal units a chunk of text sends the smallest document's
alone, others are decided where they are; in a shard, equal units that follow each other are
decided as they pass. So no task gathers a whole group of a hot one.

Defined cases: a null text has no words and stays null; a null doc_id is neither smaller nor
larger than any other, so its text is kept and marks nothing; rows that share a doc_id do
not mark each other; texts shorter than a window are kept; an empty table gives no rows; all
columns are carried along, whatever their names.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import Spans, Words, bitmap, checkpoint, chunks, in_bitmap, map_arrow, mix, whole

WINDOW = 13
ANCHOR = 5
ANCHOR_SHIFT = np.uint64(24)  # anchors are told apart by 40 bits: enough for a filter, and less to move
MAX_BITS = 1 << 30  # of the anchor bitmap: 128 MB
HOT, MAX_HOT = 2_000, 50_000
SHARD_PHRASES = 30_000
SHARD_TEXT = 1 << 20  # bytes of text that are cut at a time


def anchors(words: Words, spans: Spans, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First word of each window, and the hash of its anchor."""
    first, _ = words.grams(size)
    if not len(first):
        return first, np.zeros(0, np.uint64)
    k = min(ANCHOR, size)
    start, end = words.start, words.end
    h = spans.hash(start[: len(start) - k + 1], end[k - 1 :])
    least, span = h, 1
    reach = size - k + 1
    while span < reach:  # sliding minima by doubling
        step = min(span, reach - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    return first, least[first]


def _windows(batches, size: int):
    for b in chunks(batches, "text"):
        w = Words(b.column("text"))
        spans = Spans(w.data)
        first, anchor = anchors(w, spans, size)
        yield b, w, spans, first, anchor


def recurring_anchors(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits of the anchors that two documents at least have, at their hash modulo the number of bits; and the sorted hot anchors."""

    def run(batches):
        for b, w, _, first, anchor in _windows(batches, size):
            doc = w.owner[first]
            new = np.ones(len(doc), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
            yield pa.RecordBatch.from_arrays([pa.array((anchor[new] >> ANCHOR_SHIFT).view(np.int64)), b.column("doc_id").take(pa.array(doc[new]))], ["anchor", "doc_id"])

    found = map_arrow(docs.select("doc_id", "text"), run, "anchor long, doc_id long")
    counts = found.groupBy("anchor").agg(F.min("doc_id").alias("_a"), F.max("doc_id").alias("_b"), F.count("*").alias("n"))
    recurring = checkpoint(counts.where("_a < _b").select("anchor", "n"))
    total = recurring.agg(F.count("*").alias("anchors"), F.coalesce(F.sum("n"), F.lit(0)).alias("units")).first()
    held = bitmap(recurring, "anchor", total["anchors"], MAX_BITS)
    hot = recurring.where(F.col("n") > max(HOT, total["units"] // MAX_HOT)).select("anchor").collect()  # at most MAX_HOT rows
    return held, np.sort(np.array([r["anchor"] for r in hot], np.int64))


_UNIT = "key long, doc_id long, h long, at int, words int, text binary"


def units(docs: DataFrame, size: int) -> DataFrame:
    """(key, doc_id, h, at, words, text): units of docs(doc_id, h, text) by shard key; text is null where all of the unit's words are known to go."""
    held = docs.sparkSession.sparkContext.broadcast(recurring_anchors(docs, size))

    def run(batches):
        recurring, hot = held.value
        for b, w, spans, first, anchor in _windows(batches, size):
            anchor = (anchor >> ANCHOR_SHIFT).view(np.int64)
            chosen = in_bitmap(recurring, anchor)
            first, anchor = first[chosen], anchor[chosen]
            if not len(first):
                continue
            alone = np.isin(anchor, hot)
            owner = w.owner[first]
            begin = np.ones(len(first), bool)
            begin[1:] = (first[1:] != first[:-1] + 1) | (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1]) | alone[1:]
            begin = np.flatnonzero(begin)
            start = first[begin]
            end = first[np.append(begin[1:], len(first)) - 1] + size  # one past the last word
            s, e = w.start[start], w.end[end - 1]
            key = np.where(alone[begin], spans.hash(s, e).view(np.int64) | np.int64(-(2**63)), anchor[begin])
            raw = w.data.tobytes()
            texts: list[bytes | None] = [raw[x:y] for x, y in zip(s.tolist(), e.tolist())]
            owner = owner[begin]
            doc = b.column("doc_id").to_numpy()[owner]
            least: dict[bytes, int] = {}
            ids = doc.tolist()
            for t, d in zip(texts, ids):
                if least.setdefault(t, d) > d:
                    least[t] = d
            known = np.fromiter((least[t] < d for t, d in zip(texts, ids)), bool, len(ids))
            for i in np.flatnonzero(known).tolist():
                texts[i] = None
            key = np.where(known, mix(doc.view(np.uint64), 9).view(np.int64), key)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), pa.array(doc), b.column("h").take(pa.array(owner)), pa.array((start - w.doc[owner]).astype(np.int32)), pa.array((end - start).astype(np.int32)), pa.array(texts, pa.binary())],
                ["key", "doc_id", "h", "at", "words", "text"],
            )

    return map_arrow(docs, run, _UNIT)


def occurrences(docs: np.ndarray, texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit and first word of each window in texts that a text of a smaller doc holds too; texts are words joined by one space."""
    none = np.zeros(0, np.int64)
    w = Words(texts)
    spans = Spans(w.data)
    first, last = w.grams(size)
    if not len(first):
        return none, none
    # proposals: windows whose hash is in several documents
    h, doc = spans.hash(w.start[first], w.end[last]), docs[w.owner[first]]
    order = np.lexsort((doc, h))
    edge = np.flatnonzero(np.append(True, h[order][1:] != h[order][:-1]))
    several = doc[order][edge] != doc[order][np.append(edge[1:], len(order)) - 1]
    proposed = np.zeros(len(first), bool)
    proposed[order] = np.repeat(several, np.diff(np.append(edge, len(order))))
    example = order[edge[several]]  # a window of each proposed hash
    if not len(example):
        return none, none
    words = w.data.tobytes().split(b" ")
    number: dict[bytes, int] = {}
    some = np.unique(w.owner[first[proposed]]).tolist()
    streams = {k: tuple([number.setdefault(x, len(number)) for x in words[a:z]]) for k, a, z in zip(some, w.doc[some].tolist(), w.doc[np.array(some) + 1].tolist())}

    def phrase(i: int) -> tuple[int, ...]:
        k = int(w.owner[first[i]])
        at = int(first[i] - w.doc[k])
        return streams[k][at : at + size]

    unit, ends, which, phrases = [], [], [], 0
    todo = [phrase(i) for i in example.tolist()]
    while todo:
        for lo in range(0, len(todo), SHARD_PHRASES):
            machine = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
            for p in todo[lo : lo + SHARD_PHRASES]:
                machine.add_word(p, phrases)
                phrases += 1
            machine.make_automaton()
            for k, stream in streams.items():
                for e, i in machine.iter(stream):
                    unit.append(k)
                    ends.append(e)
                    which.append(i)
        reported = w.doc[np.array(unit, np.int64)] + np.array(ends, np.int64) - (size - 1)
        # proposed windows that no automaton has reported share a hash with other words
        todo = list({phrase(i) for i in np.flatnonzero(proposed & ~np.isin(first, reported)).tolist()})
    at_unit, at = np.array(unit, np.int64), np.array(ends, np.int64) - (size - 1)
    which = np.array(which, np.int64)
    least = np.full(phrases, np.iinfo(np.int64).max)
    np.minimum.at(least, which, docs[at_unit])
    later = docs[at_unit] > least[which]
    return at_unit[later], at[later]


def _ranges(unit: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit, first word and one past the last word of runs of consecutive windows."""
    order = np.lexsort((at, unit))
    unit, at = unit[order], at[order]
    new = np.append(True, (unit[1:] != unit[:-1]) | (at[1:] != at[:-1] + 1))[: len(unit)]
    begin = np.flatnonzero(new)
    return unit[begin], at[begin], at[np.append(begin[1:], len(unit)) - 1] + size if len(unit) else at


_COVER = ["doc_id", "h", "start", "end"]


def _cover(b: pa.RecordBatch, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    base = b.column("at").to_numpy()[row]
    row = pa.array(row)
    return pa.RecordBatch.from_arrays([b.column("doc_id").take(row), b.column("h").take(row), pa.array((base + start).astype(np.int32)), pa.array((base + end).astype(np.int32))], _COVER)


def covered(found: DataFrame, size: int) -> DataFrame:
    """(doc_id, h, start, end): ranges of words to remove, from units dealt by key."""

    def run(batches):
        left: list[pa.RecordBatch] = []  # cover of units decided on the way

        def open_units():
            before = None  # key, text and smallest doc of the equal units before this batch
            for b in batches:
                if not len(b):
                    continue
                key, doc, text = b.column("key").to_numpy(), b.column("doc_id").to_numpy(), b.column("text")
                known = text.is_null().to_numpy(zero_copy_only=False)
                same = np.append(False, pc.fill_null(pc.equal(text[1:], text[:-1]), False).to_numpy(zero_copy_only=False) & (key[1:] == key[:-1]))
                same[0] = before is not None and before[0] == key[0] and before[1] == text[0].as_py()
                run_of = np.maximum.accumulate(np.where(same, -1, np.arange(len(b))))
                least = np.where(run_of < 0, before[2] if before else 0, doc[np.maximum(run_of, 0)])
                before = (key[-1], text[-1].as_py(), least[-1]) if not known[-1] else None
                gone = known | (same & (doc > least))
                row = np.flatnonzero(gone)
                if len(row):
                    left.append(_cover(b, row, np.zeros(len(row), np.int32), b.column("words").to_numpy()[row]))
                if not gone.all():
                    yield b.filter(pa.array(~gone))

        for now in whole(open_units(), "key"):
            yield from left
            left.clear()
            b = now.combine_chunks().to_batches()[0]
            yield _cover(b, *_ranges(*occurrences(b.column("doc_id").to_numpy(), b.column("text"), size), size))
        yield from left

    dealt = found.repartition("key").sortWithinPartitions("key", "doc_id")
    return map_arrow(dealt, run, "doc_id long, h long, start int, end int")


def remove_repeats(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """(row, n_words, n_removed, kept_sha256): row holds all columns of docs, its text without the removed words.

    A text that loses words is its kept words joined by one space; others stay as they are.
    kept_sha256 is the digest of the kept words joined by one space in either case.
    """
    text = F.col("text").cast("string")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    cover = covered(units(slim.where("doc_id is not null and text is not null"), size), size)
    # a set, so that rows repeated whole add nothing; at most a range for each word of the text
    marks = cover.groupBy("doc_id", "h").agg(F.collect_set(F.struct("start", "end")).alias("ranges"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("rest"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64(text).alias("_h"), text.alias("text"))
    joined = rows.join(marks, (rows["_id"] == marks["doc_id"]) & (rows["_h"] == marks["h"]), "left").select("rest", "text", "ranges")

    def run(batches):
        for part in chunks(batches, "text", SHARD_TEXT):
            kept, total, removed, digest = [], [], [], []
            for t, ranges in zip(part.column("text").cast(pa.large_binary()).to_pylist(), part.column("ranges")):
                words = (t or b"").split()
                n = len(words)
                if ranges.is_valid:
                    cut = np.zeros(n + 1, np.int64)
                    np.add.at(cut, ranges.values.field("start").to_numpy(), 1)
                    np.add.at(cut, ranges.values.field("end").to_numpy(), -1)
                    words = [x for x, gone in zip(words, np.cumsum(cut).tolist()) if not gone]
                    t = b" ".join(words)
                kept.append(t)
                total.append(n)
                removed.append(n - len(words))
                digest.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column("rest"), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest)], ["rest", "text", "n_words", "n_removed", "kept_sha256"])

    schema = T.StructType([joined.schema["rest"], T.StructField("text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])
    done = map_arrow(joined, run, schema)
    row = F.struct(*[F.col("text") if c == "text" else F.col(f"rest.`{c}`").alias(c) for c in docs.columns])
    return done.select(row.alias("row"), "n_words", "n_removed", "kept_sha256")
