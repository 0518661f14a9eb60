"""Packing by power-of-two decomposition.

Each document's token ids, ended by one end id, are cut into pieces whose lengths are
powers of two: as many full sequences as fit, then the binary digits of the rest, the
longest first. Each piece is a sequence of its own, so no sequence crosses documents and
none is padded; sequences of equal length form a bucket, from which batches are drawn.

Tokenising is by pre-tokens: the tokenizer drops white space and joins nothing across the
borders of its pattern, so a pre-token's ids do not depend on its neighbours and are kept for the next time.

Sequence ids are the partition number and a count within it: unique, and the same when a
lost task runs again. No row is shuffled.

Defined cases: null text counts as empty, and an empty document is the end id alone;
repeated rows are packed once each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import collections
import gc
import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import chunks, keep, map_arrow, mix

SEQUENCE = 2048
END = 1
BLOCK = 1 << 21  # bytes of text that are cut at a time
PRETOKENS = 300_000  # whose ids a Python worker keeps, in each of two generations
CHUNK_CHARACTERS, LONG_PRETOKEN = 8_000_000, 64  # new characters after which a generation is full; longer pre-tokens are not kept

_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bucket int, ids binary"


def pieces(n: int, longest: int = SEQUENCE) -> list[int]:
    """Lengths of the pieces of n ids: full sequences, then the binary digits of the rest."""
    full, rest = divmod(n, longest)
    return [longest] * full + [1 << b for b in range(longest.bit_length() - 1, -1, -1) if rest >> b & 1]


class Encoder:
    """Ids of texts by a lower-casing BPE tokenizer with word ends, as little-endian uint32 bytes.

    Stretches of common Latin characters are cut into pre-tokens here, and the distinct ones that are not
    yet known are encoded many at a time: the ids that end a word show where each one ends. A white-space
    chunk with any other character goes through the whole tokenizer, and so does one that spells
    an added token, such as the end of text, which the tokenizer gives that token's id. What is known is
    kept in two generations: a full one becomes the old one, from which what occurs again is taken over.
    In front of them stands a table of arrays, which most pre-tokens of plain stretches are found in.
    """

    OTHER = re.compile("[^\t-\r -~À-ÖØ-öø-ÿ]")  # normalisation does more to these than lower-casing
    WHITE = re.compile(r"[^\S\x1c-\x1f]")  # to the tokenizer; str.split would take four separators for white space too
    MARK = " "  # leads the key of a chunk that goes through the whole tokenizer; no pre-token has one

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.words = Tokenizer(self.whole.model)
        self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.either = re.compile("|".join([self.OTHER.pattern, *map(re.escape, self.added)]))
        vocab = self.whole.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.pretokens: dict[str, bytes] = {}
        self.old_pretokens: dict[str, bytes] = {}
        self.characters = 0
        self.table = Table()  # of this generation's short pre-tokens

    @classmethod
    def get(cls, path: str) -> Encoder:
        kept = keep(__name__)
        if path not in kept:
            kept[path] = cls(path)
        return kept[path]

    def _parts(self, text: str) -> list[str]:
        """Plain stretches of the text, with a chunk that has a special character or added token between any two."""
        added = any(t in text for t in self.added)
        if not added and not self.OTHER.search(text):
            return [text]
        text = self.WHITE.sub(" ", text)
        special = self.either if added else self.OTHER
        parts, done = [], 0
        while m := special.search(text, done):
            begin = text.rfind(" ", done, m.start()) + 1 or done
            end = text.find(" ", m.end())
            end = end if end >= 0 else len(text)
            parts += [text[done:begin], text[begin:end]]
            done = end
        return [*parts, text[done:]]

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]

    def _pretokens(self, new: list[str]) -> None:
        for at in range(0, len(new), 200):
            part = new[at : at + 200]
            ids = np.array(self.words.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            cuts = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(cuts) != len(part) or cuts[-1] != len(ids):
                self.pretokens.update(zip(part, self._whole(part)))
                continue
            raw, last = ids.tobytes(), 0
            for w, cut in zip(part, cuts):
                self.pretokens[w] = raw[4 * last : 4 * cut]
                last = cut

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.pretokens) > PRETOKENS or self.characters > CHUNK_CHARACTERS:
            self.old_pretokens, self.pretokens, self.characters, self.table = self.pretokens, {}, 0, Table()
        collects = gc.isenabled()
        gc.disable()  # nothing here is cyclic, and each collection would walk all lists of pre-tokens
        try:
            parts = list(map(self._parts, texts))
            plain = iter(self._plain([p for ps in parts for p in ps[::2]]))
            known = self._known({self.MARK + p for ps in parts for p in ps[1::2]})
            return [b"".join([known[self.MARK + p] if i % 2 else next(plain) for i, p in enumerate(ps)]) for ps in parts]
        finally:
            if collects:
                gc.enable()

    def _known(self, wanted: set[str]) -> dict[str, bytes]:
        """A dictionary that has the ids of the wanted keys; those of long ones are forgotten with it."""
        known, old = self.pretokens, self.old_pretokens
        unknown = wanted.difference(known)
        self.characters += sum(map(len, unknown))
        known.update((k, old[k]) for k in old.keys() & unknown)
        new = [k for k in unknown if k not in known]
        self._pretokens([k for k in new if k[0] != self.MARK])
        special = [k for k in new if k[0] == self.MARK]
        known.update(zip(special, self._whole([k[1:] for k in special])))
        long = {k: known.pop(k) for k in new if len(k) > LONG_PRETOKEN}
        return collections.ChainMap(long, known) if long else known

    def _plain(self, texts: list[str]) -> list[bytes]:
        """Ids of texts without special characters: cut, told apart and put together as arrays, so that only distinct pre-tokens are Python objects."""
        raw = [t.lower().encode() for t in texts]
        data = b"\n".join([*raw, b""])
        starts, after, out, at = [], [np.zeros(1, np.int64)], [], 0
        while at < len(data):  # once, but for very long texts
            space = _WHITE.search(data, at + BLOCK)
            block = data[at : space.end() if space else len(data)]
            start, end = cuts(np.frombuffer(block, np.uint8))
            if len(start):
                which, example, hashed, key = distinct(block, start, end)
                offset, size, pool = self.table.look_up(block, start, end, example, hashed, key, self._known)
                count = size[which]
                done = np.cumsum(count)
                place = np.repeat(offset[which] - (done - count), count)
                place += np.arange(len(place))
                out.append(pool[place].tobytes())
                starts.append(start + at)
                after.append(done + after[-1][-1])
            at += len(block)
        if not out:
            return [b""] * len(texts)
        ids = b"".join(out)
        # each text's ids lie between those before its first pre-token and those before the next text's
        first = np.searchsorted(np.concatenate(starts), np.cumsum([0, *[len(r) + 1 for r in raw]]))
        edge = (4 * np.concatenate(after)[first]).tolist()
        return [ids[a:z] for a, z in itertools.pairwise(edge)]


_WHITE = re.compile(rb"[\t-\r ]")
_SPACE, _LETTER, _DIGIT, _OTHER = range(4)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[*range(9, 14), 32]] = _SPACE
_KIND[[*range(ord("a"), ord("z") + 1), *range(128, 256)]] = _LETTER
_KIND[ord("0") : ord("9") + 1] = _DIGIT
_KEY_BYTES = 24  # of a pre-token that are compared as numbers; longer ones are Python objects one by one
_LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)  # masks of the lowest n bytes


def cuts(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where pre-tokens start and end in lower-cased bytes of plain Latin text that end in white space.

    Fixed rule, the tokenizer's own: 's 't 're 've 'm 'll 'd, a run of letters, a digit, a run of anything else.
    """
    kind = _KIND[data]
    filled = kind != _SPACE
    begins = filled.copy()
    begins[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    # a clitic is an apostrophe that begins a pre-token and the letters after it; what letters follow begin another
    quote = np.flatnonzero(begins & (data == ord("'")))
    if len(quote):
        padded = np.append(data, np.zeros(2, np.uint8))
        one, two = padded[quote + 1], padded[quote + 2]
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        pair = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        begins[quote[short | pair] + 1] = False
        for at in (quote[short] + 2, quote[pair] + 3):
            begins[at] = filled[at]
    start = np.flatnonzero(begins)
    last = filled.copy()
    last[:-1] &= begins[1:] | ~filled[1:]
    return start, np.flatnonzero(last) + 1


def distinct(data: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, np.ndarray]:
    """The number of each range's bytes, an example of each number, how many of these have a hash of their own, and the examples' keys.

    A key is the hash and the first _KEY_BYTES bytes as numbers. Bytes decide: hashes only sort.
    """
    size = end - start
    words = np.ndarray(len(data) + _KEY_BYTES - 7, "<u8", data + bytes(_KEY_BYTES), strides=(1,)).copy()  # eight bytes from each place
    parts = [words[np.minimum(start + at, len(data))] & _LOW[np.clip(size - at, 0, 8)] for at in range(0, _KEY_BYTES, 8)]
    h = np.bitwise_xor.reduce([mix(p, salt) for salt, p in enumerate(parts)])
    order = np.argsort(h)
    new = np.append(True, h[order][1:] != h[order][:-1])
    example = order[new]
    which = np.empty(len(h), np.int64)
    which[order] = np.cumsum(new) - 1
    hashed, like = len(example), example[which]
    alone = size > _KEY_BYTES
    for p in parts:
        alone |= p != p[like]
    alone |= alone[like]
    rest = np.flatnonzero(alone)
    if len(rest):
        number: dict[bytes, int] = {}
        more = []
        for i, a, z in zip(rest.tolist(), start[rest].tolist(), end[rest].tolist()):
            word = data[a:z]
            if word not in number:
                number[word] = hashed + len(number)
                more.append(i)
            which[i] = number[word]
        example = np.append(example, more)
    return which, example, hashed, np.array([h[example], *[p[example] for p in parts]])


class Table:
    """Ids of pre-tokens of at most _KEY_BYTES bytes, found by arrays: keys sorted by hash, one key for each hash."""

    def __init__(self) -> None:
        self.key = np.zeros((1 + _KEY_BYTES // 8, 0), np.uint64)
        self.offset = self.size = np.zeros(0, np.int64)
        self.pool = np.zeros(0, "<u4")

    def look_up(self, data: bytes, start: np.ndarray, end: np.ndarray, example: np.ndarray, hashed: int, key: np.ndarray, known) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the ids of the examples lie in a pool, how many, and the pool; known gives those that are not here yet."""
        short = (end - start)[example] <= _KEY_BYTES
        offset, size = np.zeros(len(example), np.int64), np.zeros(len(example), np.int64)
        taken = hit = np.zeros(len(example), bool)
        if self.key.shape[1]:
            at = np.minimum(np.searchsorted(self.key[0], key[0]), self.key.shape[1] - 1)
            taken = self.key[0][at] == key[0]
            hit = short & (self.key[:, at] == key).all(axis=0)
            offset[hit], size[hit] = self.offset[at[hit]], self.size[at[hit]]
        joins = short & ~taken & (np.arange(len(example)) < hashed)
        miss = np.append(np.flatnonzero(joins), np.flatnonzero(~hit & ~joins))
        if not len(miss):
            return offset, size, self.pool
        i = example[miss]
        words = b"\n".join([data[a:z] for a, z in zip(start[i].tolist(), end[i].tolist())]).decode().split("\n")
        ids = list(map(known(set(words)).__getitem__, words))
        size[miss] = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        offset[miss] = len(self.pool) + np.cumsum(size[miss]) - size[miss]
        pool = np.append(self.pool, np.frombuffer(b"".join(ids), "<u4"))
        if joins.any():
            self.pool = pool[: len(self.pool) + size[joins].sum()]
            order = np.argsort(np.append(self.key[0], key[0][joins]), kind="stable")
            self.key = np.append(self.key, key[:, joins], axis=1)[:, order]
            self.offset, self.size = np.append(self.offset, offset[joins])[order], np.append(self.size, size[joins])[order]
        return offset, size, pool


def pack(docs: DataFrame, tokenizer: str, longest: int = SEQUENCE, end: int = END, keep_ids: bool = True) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket (log2 of the length), ids.

    longest must be a power of two. ids are little-endian unsigned 32-bit; keep_ids=False leaves them null.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest sequence must be a power of two")
    tail = np.array([end], "<u4").tobytes()

    rests = [tuple(pieces(n, longest)) for n in range(longest)]

    def run(batches):
        count = 0
        encoder = Encoder.get(tokenizer)
        for part in chunks(batches, "text"):
            ids = encoder.encode([t or "" for t in part.column("text").to_pylist()])
            n = np.fromiter(map(len, ids), np.int64, len(ids)) // 4 + 1
            data = memoryview(b"".join([x + tail for x in ids]))
            cut = [(longest,) * (k // longest) + rests[k % longest] for k in n.tolist()]
            each = np.fromiter(map(len, cut), np.int64, len(cut))
            length = np.fromiter(itertools.chain.from_iterable(cut), np.int64, int(each.sum()))
            end = np.cumsum(length)  # in all the ids of this part
            row = np.repeat(np.arange(len(ids)), each)
            spans = list(zip((4 * (end - length)).tolist(), (4 * end).tolist()))
            crc = [zlib.crc32(data[a:z]) for a, z in spans]
            kept = pa.array([data[a:z].tobytes() for a, z in spans], pa.binary()) if keep_ids else pa.nulls(len(spans), pa.binary())
            sequence = (part.column("part").to_numpy()[row] << 40) + count + np.arange(len(row))
            count += len(row)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(pa.array(row)), *map(pa.array, (end - length - (np.cumsum(n) - n)[row], length)), pa.array(crc, pa.int64()), *map(pa.array, (n[row], sequence, np.zeros(len(row), np.int64), np.log2(length).astype(np.int32))), kept],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket", "ids"],
            )

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.spark_partition_id().cast("long").alias("part")), run, _SCHEMA)


def write_buckets(packed: DataFrame, path: str) -> None:
    """Write sequences in one folder for each length."""
    packed.write.partitionBy("bucket").parquet(path)
