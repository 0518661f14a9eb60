"""SimHash near-duplicate detection by binary-trie self-joins.

Fingerprints: each bit is the majority of that bit over the XXH64 of a document's word
shingles, repeats included; a document of fewer words has one shingle, its whole word
sequence; one without words has fingerprint zero.

Join: equal fingerprints are collapsed first: they are one node, whatever their documents.
A pair within the error budget agrees on some chosen set of bits, so for each such set (a
table) the fingerprints are read as paths of a binary trie that starts with these bits:
subtries under different starts are independent tasks. Below a start, pairs of nodes are
traversed together; the differing bits of their paths are added up, and a pair is dropped
once they exceed the budget. A pair of nodes whose members all hang together already is
dropped too, and a task returns one link for each member of what hangs together, never all
pairs of a group. Subtries of up to SMALL members are leaves: their members are compared
directly, many starts at a time; on ordinary data, whose starts are short of company, most
pairs are decided there.

Defined cases: null text counts as empty; all documents without words link to each
other; repeated rows are each returned; rows that share a doc_id are documents of their own;
a null doc_id gets its group's component and names none, so a group of null ids alone has a
null component_id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Words, checkpoint, chunks, map_arrow, mix, whole
from tessera.llm.components import connected_components

LANES = np.uint64(0x0101010101010101)
SMALL = 48  # subtries under one start up to this size are leaves, larger ones are traversed
LEAF = 64  # node pairs up to this size are compared directly


def xxh64(words: Words, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """XXH64 with seed 42 of each shingle's bytes."""
    data, f = words.data.tobytes(), xxhash.xxh64_intdigest
    found = (f(data[s:e], 42) for s, e in zip(words.start[first].tolist(), words.end[last].tolist()))
    return np.fromiter(found, np.uint64, len(first))


def majority(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Bits set in over half of each group's hashes; groups are contiguous and not empty.

    Eight byte-wide counters are added in one 64-bit word, in blocks of at most 255 hashes.
    """
    blocks = (counts + 254) // 255
    block_of = np.cumsum(blocks) - blocks
    which = np.arange(int(blocks.sum())) - np.repeat(block_of, blocks)
    at = np.repeat(np.cumsum(counts) - counts, blocks) + which * 255
    out = np.zeros(len(counts), np.uint64)
    for r in range(8):
        part = np.add.reduceat((h >> np.uint64(r)) & LANES, at)
        lanes = part.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64)
        over = np.add.reduceat(lanes, block_of, axis=0) * 2 > counts[:, None]
        for j in range(8):
            out |= over[:, j].astype(np.uint64) << np.uint64(8 * j + r)
    return out


def prints_of(h: np.ndarray, n: np.ndarray, words: int = 1) -> np.ndarray:
    """Fingerprints (len(n) x words) of n[i] hashes each, laid end to end; each word over an independent hash, the first over h itself."""
    out = np.zeros((len(n), words), np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        for k in range(words):
            out[some, k] = majority(mix(h, k) if k else h, n[some])
    return out


def packed(prints: np.ndarray) -> pa.Array:
    """Fingerprints as binary values, most significant bit first."""
    width = 8 * prints.shape[1]
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(prints), [None, pa.py_buffer(prints.astype(">u8").tobytes())]).cast(pa.binary())


def unpacked(column: pa.Array | pa.ChunkedArray, words: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u8").astype(np.uint64).reshape(-1, words)


def fingerprints(docs: DataFrame, size: int = 4) -> DataFrame:
    """(doc_id, fingerprint binary, node): the majority bits over the XXH64 of all shingles, repeats included; node is the same 64 bits as a number."""

    def run(batches):
        for b in chunks(batches, "text"):
            w = Words(b.column("text"), lower=True)
            first, last = w.shingles(size)
            prints = prints_of(xxh64(w, first, last), np.bincount(w.owner[first], minlength=len(b)).astype(np.int64))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), packed(prints), pa.array(prints[:, 0].view(np.int64))], ["doc_id", "fingerprint", "node"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, fingerprint binary, node long")


def exact_tables(bits: int, budget: int, n: int) -> list[np.ndarray]:
    """Bit sets of which every pair within the budget agrees on one: all choices of blocks that so many errors leave untouched.

    More blocks make longer starts: two blocks at least, and as many as keep about 16 of n random fingerprints under one.
    """
    for blocks in range(budget + 2, budget + 5):
        parts = np.array_split(np.arange(bits), blocks)
        tables = [np.concatenate(x) for x in itertools.combinations(parts, blocks - budget)]
        if n <= 16 * 2 ** min(map(len, tables)):
            break
    return tables


class Forest:
    """Union-find over positions 0..n-1, with arrays for vectorised look-ups."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def roots(self, ids: np.ndarray) -> np.ndarray:
        r = self.up[ids]
        while (nxt := self.up[r]).tobytes() != r.tobytes():
            r = nxt
        self.up[ids] = r
        return r

    def join(self, i: int, j: int) -> bool:
        a, b = self.root(i), self.root(j)
        self.up[max(a, b)] = min(a, b)
        return a != b


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def trie_links(prints: np.ndarray, budget: int, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among rows of prints (n x words, sorted, distinct); with known, of those between what known numbers apart."""
    n, words = prints.shape
    forest, links = Forest(n), []
    if known is not None:
        _, first, which = np.unique(known, return_index=True, return_inverse=True)
        forest.up = first[which]

    def branch(lo: int, hi: int, depth: int) -> tuple[int, int]:
        """Where a node's members part: the first bit at or below depth that varies, and the position of the first 1."""
        varies = prints[lo] ^ prints[hi - 1]
        k = int(np.flatnonzero(varies)[0])
        depth = max(depth, 64 * k + 64 - int(varies[k]).bit_length())
        bit = (prints[lo:hi, depth // 64] >> np.uint64(63 - depth % 64)) & np.uint64(1)
        return depth, hi - int(bit.sum())

    def masks(depth: int) -> np.ndarray:
        whole = (1 << 64 * words) - (1 << (64 * words - depth))
        return np.array([(whole >> 64 * (words - 1 - k)) & (2**64 - 1) for k in range(words)], np.uint64)

    todo = [(0, n, 0, 0, n, 0)]
    while todo:
        alo, ahi, ad, blo, bhi, bd = todo.pop()
        same = alo == blo
        if same and ahi - alo < 2:
            continue
        if not same:
            fixed = masks(min(ad, bd))
            if distance(prints[alo] & fixed, prints[blo] & fixed) > budget:
                continue  # the error budget is spent on the paths alone
        ra, rb = forest.roots(np.arange(alo, ahi)), forest.roots(np.arange(blo, bhi))
        if (ra == ra[0]).all() and (rb == ra[0]).all():
            continue  # all of them hang together already
        if max(ahi - alo, bhi - blo) <= LEAF:
            close = (distance(prints[alo:ahi, None], prints[None, blo:bhi]) <= budget) & (ra[:, None] != rb)
            for i, j in zip(*np.nonzero(np.triu(close, 1) if same else close)):
                if forest.join(alo + int(i), blo + int(j)):
                    links.append((alo + int(i), blo + int(j)))
        elif same:
            d, mid = branch(alo, ahi, ad)
            todo += [(alo, mid, d + 1, mid, ahi, d + 1), (mid, ahi, d + 1, mid, ahi, d + 1), (alo, mid, d + 1, alo, mid, d + 1)]
        elif ahi - alo >= bhi - blo:
            d, mid = branch(alo, ahi, ad)
            todo += [(alo, mid, d + 1, blo, bhi, bd), (mid, ahi, d + 1, blo, bhi, bd)]
        else:
            d, mid = branch(blo, bhi, bd)
            todo += [(alo, ahi, ad, blo, mid, d + 1), (alo, ahi, ad, mid, bhi, d + 1)]
    return links


def firsts(key: np.ndarray, group: np.ndarray) -> np.ndarray:
    """For each row the first one with the same key and group."""
    order = np.lexsort((group, key))
    new = np.append(True, (key[order][1:] != key[order][:-1]) | (group[order][1:] != group[order][:-1]))
    out = np.empty(len(key), np.int64)
    out[order] = order[new][np.cumsum(new) - 1] if len(key) else order
    return out


def _subtries(key: np.ndarray, prints: np.ndarray, ids: np.ndarray, budget: int, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links below each start, for rows sorted by key: from the smallest id of what hangs together there to each other member.

    With group, rows of one group hang together already: only links between groups are made, one for each group
    but the first of what hangs together.
    """
    order = np.lexsort((ids, key))
    key, prints, ids = key[order], prints[order], ids[order]
    head = np.arange(len(key)) if group is None else firsts(key, group[order])
    a, b = [], []
    edge = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(edge, len(key)))
    small = np.repeat(size <= SMALL, size)
    for step in range(1, int(size[size <= SMALL].max(initial=0))):
        i = np.flatnonzero((key[:-step] == key[step:]) & small[:-step] & (head[:-step] != head[step:]))
        i = i[distance(prints[i], prints[i + step]) <= budget]
        a.append(i)
        b.append(i + step)
    for lo, n in zip(edge[size > SMALL], size[size > SMALL]):
        order = lo + np.lexsort(prints[lo : lo + n].T[::-1])
        pairs = np.array(trie_links(prints[order], budget, None if group is None else head[order]), np.int64).reshape(-1, 2)
        a.append(order[pairs[:, 0]])
        b.append(order[pairs[:, 1]])
    i, j = head[np.concatenate([*a, np.zeros(0, np.int64)])], head[np.concatenate([*b, np.zeros(0, np.int64)])]
    root, last = np.arange(len(key)), None
    while last is None or (root != last).any():
        last = root.copy()
        least = np.minimum(root[i], root[j])
        np.minimum.at(root, i, least)
        np.minimum.at(root, j, least)
        root = root[root]
    member = np.flatnonzero(root != np.arange(len(key)))
    return ids[root[member]], ids[member]


def trie_join(keyed: DataFrame, budget: int, bits: int) -> DataFrame:
    """(a, b): links that connect, under each key, all nodes of keyed(key, fingerprint, node) within the budget.

    Where keyed has a group too, nodes of one group hang together already, and only groups are connected.
    """
    words, grouped = bits // 64, "group" in keyed.columns

    def traverse(batches):
        for now in whole(batches, "key"):
            a, c = _subtries(now.column("key").to_numpy(), unpacked(now.column("fingerprint"), words), now.column("node").to_numpy(), budget, now.column("group").to_numpy() if grouped else None)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(c)], ["a", "b"])

    found = map_arrow(keyed.repartition("key").sortWithinPartitions("key"), traverse, "a long, b long")
    # a member has a root under each key at most; a chain through them, which most members share, links as much
    roots = found.groupBy("b").agg(F.sort_array(F.collect_set("a")).alias("r"))
    chain = F.concat(F.array(F.struct(F.col("r")[0].alias("a"), F.col("b"))), F.transform(F.sequence(F.lit(0), F.size("r") - 2), lambda i: F.struct(F.get("r", i).alias("a"), F.get("r", i + 1).alias("b"))))
    one = F.array(F.struct(F.col("r")[0].alias("a"), F.col("b")))
    return roots.select(F.inline(F.when(F.size("r") > 1, chain).otherwise(one))).distinct()


def links(nodes: DataFrame, tables: list[np.ndarray], budget: int, bits: int) -> DataFrame:
    """(a, b): links that connect all nodes(fingerprint, node) within the budget that some table brings under one start."""

    def starts(batches):
        for b in batches:
            if not len(b):
                continue
            each = np.unpackbits(np.frombuffer(b"".join(b.column("fingerprint").to_pylist()), np.uint8).reshape(-1, bits // 8), axis=1)
            for t, chosen in enumerate(tables):
                weights = np.left_shift(np.int64(1), np.arange(len(chosen), dtype=np.int64))
                key = each[:, chosen] @ weights * len(tables) + t
                yield pa.RecordBatch.from_arrays([pa.array(key), b.column("fingerprint"), b.column("node")], ["key", "fingerprint", "node"])

    return trie_join(map_arrow(nodes.select("fingerprint", "node"), starts, "key long, fingerprint binary, node long"), budget, bits)


def near_duplicates(docs: DataFrame, size: int = 4, budget: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id): component_id is the smallest doc_id reachable over links of budget or fewer differing bits; every link counts."""
    prints = checkpoint(fingerprints(docs, size))
    nodes = checkpoint(prints.groupBy("node").agg(F.min("fingerprint").alias("fingerprint"), F.min("doc_id").alias("least")))
    found = connected_components(links(nodes, exact_tables(64, budget, nodes.count()), budget, 64))
    grouped = nodes.join(found, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component"))
    least = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    named = grouped.join(least, "component").select(F.col("node").alias("_n"), "component_id")
    return prints.join(named, F.col("node") == F.col("_n")).select("doc_id", "fingerprint", "component_id")
