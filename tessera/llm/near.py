"""Near duplicates by the similarity of their shingle sets: SimHash tries propose, exact sets decide.

Words are lower-cased runs without ASCII punctuation; a document's set is its distinct
shingles (the whole sequence for fewer words). Two documents link if the Jaccard similarity
of their sets reaches the bound; a group is what hangs together over such links. Texts of
equal sets are one node from the start, named by 64 bits of the set.

1. Proposals. Each node has a SimHash fingerprint of BITS bits over its set and MINS minimum
   hashes. Nodes that share a minimum meet, as the start of a binary trie, and the trie join
   links those within BUDGET differing bits. Two sets with a similarity of 0.8 share none of 6
   minima with probability 0.2**6 = 0.00006, and differ in more than 56 of 256 bits with about
   0.001. How often a node is copied depends on neither the number of nodes nor its length.
   Texts of up to SHORT shingles, whose fingerprints say little, meet under the smallest hashes of their
   sets instead: sets so alike share one of the few first ones, so none of these is missed.
2. Decisions. One text of each proposed node is read again, and the sets of what hangs
   together over proposals are compared, rarest shingles first. Sets are of 40-bit hashes.

Hot keys. A key that more than HOT nodes share (and more than one of MAX_HOT of all rows, so a
table of hot keys to broadcast has MAX_HOT rows at most) is dealt into blocks at random before
its rows move, DEALINGS times, each block with the same ANCHORS of the key's nodes, drawn at
random, so that the blocks of a crowd of near texts hang together through them; in step 2 it is
split by the minima first. This loses no link: what does not hang together then under a hot key
is compared in full, all of it with all nodes of the key, in pairs of parts. Each row brings the
group that it is known to be in, and only links between groups are returned. The rows compared
are the size of a crowd times the number of its nodes outside its largest group, over HOT / 2.

Defined cases: null text counts as empty; all documents without words are one group; rows
that share a doc_id, or have none, are documents of their own, told apart by their text; an
empty table gives no rows; all columns are carried along, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Spans, Words, bitmap, checkpoint, chunks, in_bitmap, map_arrow, mix, whole
from tessera.llm.components import connected_components
from tessera.llm.simhash import firsts, packed, prints_of, trie_join

SIZE, SIMILARITY = 5, 0.8
BITS, BUDGET, MINS = 256, 56, 6
SHORT = 40  # texts of up to so many distinct shingles are found by their shingle sets, not by fingerprints
HOT, MAX_HOT = 512, 50_000
WHOLE = 512  # nodes that hang together over proposals and are compared in one task
ANCHORS, DEALINGS = 32, 2
TABLES = 8  # of no effect: hot keys are no longer split by fingerprint bits; a test names it
MAX_BITS = 1 << 30  # of the bitmap of texts to read again: 128 MB

_OWN = np.uint64(40)  # bits of a shingle's hash that tell it from others of its document


def distinct(words: Words, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and hash of each document's distinct shingles, so that a line repeated a thousand times weighs as one."""
    h = Spans(words.data).hash(words.start[first], words.end[last]) >> (np.uint64(64) - _OWN)
    h |= words.owner[first].astype(np.uint64) << _OWN
    h.sort()
    h = h[np.append(True, h[1:] != h[:-1])] if len(h) else h
    return (h >> _OWN).astype(np.int64), h & np.uint64((1 << int(_OWN)) - 1)


def shingle_sets(docs: DataFrame, size: int, most: int | None = None, wanted=None) -> DataFrame:
    """The columns of docs but text; node, n, fingerprint, mins, and set: a text's n distinct shingles as sorted 8-byte hashes, null beyond most.

    Texts of equal sets have the same node; that of a text without words is 0. With wanted, a
    broadcast bitmap over the column `_w`, rows whose bit is not set are left out and only sets are made.
    """
    names = [c for c in docs.columns if c not in ("text", "_w")]

    def chosen(batches):
        for b in batches:
            yield b if wanted is None else b.filter(pa.array(in_bitmap(wanted.value, b.column("_w").to_numpy())))

    def run(batches):
        for b in chunks(chosen(batches), "text"):
            w = Words(b.column("text"), lower=True, plain=True)
            owner, h = distinct(w, *w.shingles(size))
            n = np.bincount(owner, minlength=len(b)).astype(np.int64)
            some = np.flatnonzero(n)
            at = np.append(0, np.cumsum(n))
            total, mins = np.zeros(len(b), np.uint64), np.zeros((len(b), MINS), np.uint64)
            if len(some) and wanted is None:
                total[some] = mix(np.add.reduceat(mix(h, 77), at[some]) + n[some].astype(np.uint64))
                for k in range(MINS):
                    mins[some, k] = np.minimum.reduceat(mix(h, 100 + k), at[some])
            sets = [h[at[i] : at[i + 1]].tobytes() if most is None or n[i] <= most else None for i in range(len(b))]
            prints = packed(prints_of(mix(h, 11), n, BITS // 64)) if wanted is None else pa.nulls(len(b), pa.binary())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, MINS * len(b) + 1, MINS, dtype=np.int32)), pa.array(mins.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(total.view(np.int64)), pa.array(n), prints, lists, pa.array(sets, pa.binary())], [*names, "node", "n", "fingerprint", "mins", "set"])

    return map_arrow(docs, run, ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in names) + ", node long, n long, fingerprint binary, mins array<long>, set binary")


def _prefix(sizes: np.ndarray, similarity: float) -> np.ndarray:
    """How many of a set's first shingles, in any order common to all sets, one of which every set so alike shares."""
    return sizes - np.ceil(similarity * sizes - 1e-9).astype(np.int64) + 1


def alike(flat: np.ndarray, sizes: np.ndarray, similarity: float, head: np.ndarray | None = None) -> np.ndarray:
    """For each of some sets, none of them empty and laid end to end, the first set it hangs together with over exact links.

    With head, a set hangs together with the set head[i], the first of its group, from the start.
    """
    n, at = len(sizes), np.cumsum(sizes) - sizes
    head = np.arange(n) if head is None else head
    members = np.argsort(head, kind="stable")
    group = np.searchsorted(head[members], np.arange(n + 1))
    owner = np.repeat(np.arange(n), sizes)
    _, token, count = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(count))
    token = rank[token]
    token = token[np.lexsort((token, owner))]  # each set from its rarest shingle on
    first = _prefix(sizes, similarity)
    early = np.arange(len(token)) - at[owner] < first[owner]
    order = np.argsort(token[early], kind="stable")
    posted, edge = owner[early][order], np.searchsorted(token[early][order], np.arange(len(count) + 1))
    root, has, left = np.full(n, -1), np.zeros(len(count), bool), n
    for i in range(n):
        if root[i] >= 0:
            continue
        todo = members[group[i] : group[i + 1]].tolist()  # i is the first of its group
        root[todo], left = i, left - len(todo)
        while todo and left:
            p = todo.pop()
            mine = token[at[p] : at[p] + sizes[p]]
            near = mine[: first[p]]
            near = near[edge[near + 1] - edge[near] > 1].tolist()
            if not near:
                continue
            near = np.unique(np.concatenate([posted[edge[t] : edge[t + 1]] for t in near]))
            near = near[root[near] < 0]
            near = near[np.minimum(sizes[near], sizes[p]) >= similarity * np.maximum(sizes[near], sizes[p])]
            if not len(near):
                continue
            has[mine] = True
            begin = np.cumsum(sizes[near]) - sizes[near]
            held = has[token[np.repeat(at[near] - begin, sizes[near]) + np.arange(int(sizes[near].sum()))]]
            has[mine] = False
            shared = np.add.reduceat(held.astype(np.int64), begin)
            found = near[shared >= similarity * (sizes[near] + sizes[p] - shared)]
            for g in np.unique(head[found]).tolist():
                more = members[group[g] : group[g + 1]]
                root[more], left = i, left - len(more)
                todo += more.tolist()
    return root


def _verified(similarity: float):
    """Of rows (key, node, set) sorted by key, the links among the sets of each key; with a group, those between groups."""

    def run(batches):
        for now in whole(batches, "key"):
            key, node = now.column("key").to_numpy(), now.column("node").to_numpy()
            sets = now.column("set").to_pylist()
            head = firsts(key, now.column("group").to_numpy()) if "group" in now.column_names else np.arange(len(now))
            edge = np.flatnonzero(np.append(True, key[1:] != key[:-1])).tolist() + [len(key)]
            a, b = [], []
            for lo, hi in zip(edge, edge[1:]):
                if hi - lo > 1:
                    sizes = np.array([len(x) // 8 for x in sets[lo:hi]])
                    root = alike(np.frombuffer(b"".join(sets[lo:hi]), np.uint64), sizes, similarity, head[lo:hi] - lo)
                    member = np.flatnonzero((root != np.arange(hi - lo)) & (head[lo:hi] == np.arange(lo, hi)))
                    a.append(node[lo + root[member]])
                    b.append(node[lo + member])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return run


def hot_keys(keyed: DataFrame, total: int, most: int) -> DataFrame | None:
    """(key, n, parts) of the keys that more than `most` rows have, and parts of about half as many rows each; None if there is none."""
    most = max(most, total // MAX_HOT)
    rows = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > most).collect()  # at most MAX_HOT
    return keyed.sparkSession.createDataFrame([(r["key"], r["n"], math.ceil(2 * r["n"] / most)) for r in rows], "key long, n long, parts int") if rows else None


def _marked(keyed: DataFrame, hot: DataFrame) -> DataFrame:
    return keyed.join(F.broadcast(hot), "key", "left")


def dealt(keyed: DataFrame, hot: DataFrame | None) -> DataFrame:
    """keyed(key, node, ...) with the rows of hot keys under keys of blocks that share anchors."""
    if hot is None:
        return keyed
    keys = []
    for d in range(DEALINGS):
        draw = F.xxhash64("node", "key", F.lit(d))
        every = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: F.xxhash64(F.col("key"), F.lit(d), i.cast("long")))  # noqa: B023
        own = F.array(F.xxhash64(F.col("key"), F.lit(d), F.pmod(draw, F.col("parts").cast("long"))))
        keys.append(F.when(F.pmod(F.xxhash64(draw), F.col("n")) < ANCHORS, every).otherwise(own))
    to = F.when(F.col("n").isNull(), F.array("key")).otherwise(F.concat(*keys))
    return _marked(keyed, hot).withColumn("key", F.explode(to)).drop("n", "parts")


def rest(keyed: DataFrame, hot: DataFrame, links: DataFrame, most: int) -> DataFrame | None:
    """Rows of keyed(key, node, ...) under keys of pairs of parts, so that any two nodes of a hot key that links(a, b) do not hold together meet; None if all do.

    They have a column more, group: what links hold together. The largest group of a key is one side, in parts; the other nodes meet it and each other.
    """
    near = keyed.join(F.broadcast(hot.select("key")), "key").join(connected_components(links), "node", "left").withColumn("_c", F.coalesce("component", "node")).drop("component")
    sizes = near.groupBy("key", "_c").agg(F.count("*").alias("k"))
    per = sizes.groupBy("key").agg(F.sum("k").alias("n"), F.max(F.struct("k", "_c")).alias("b")).where("n > b.k")
    half = max(1, most // 2)
    rows = [(r["key"], r["b"]["_c"], math.ceil((r["n"] - r["b"]["k"]) / half), math.ceil(r["b"]["k"] / half)) for r in per.collect()]  # at most MAX_HOT
    if not rows:
        return None
    plan = keyed.sparkSession.createDataFrame(rows, "key long, _main long, _r int, _p int")
    draw, main = F.xxhash64("node", "key", F.lit(DEALINGS)), F.col("_c") == F.col("_main")
    part = F.when(main, F.col("_r") + F.pmod(draw, F.col("_p").cast("long"))).otherwise(F.pmod(draw, F.col("_r").cast("long")))
    met = near.join(F.broadcast(plan), "key").withColumn("_i", part)
    others = F.sequence(F.lit(0), F.when(main, F.col("_r")).otherwise(F.col("_r") + F.col("_p")) - 1)
    keys = F.transform(F.filter(others, lambda j: j != F.col("_i")), lambda j: F.xxhash64(F.col("key"), F.least(j.cast("long"), F.col("_i")), F.greatest(j.cast("long"), F.col("_i"))))
    return met.withColumn("key", F.explode(keys)).select(*keyed.columns, F.col("_c").alias("group"))


def proposals(nodes: DataFrame) -> DataFrame:
    """(a, b): links that connect nodes(node, fingerprint, mins) which share a minimum and differ in BUDGET bits at most."""
    keyed = nodes.select(F.explode(F.transform("mins", lambda m, i: F.xxhash64(m, i))).alias("key"), "node", "fingerprint")
    hot = hot_keys(keyed.select("key"), MINS * nodes.count(), HOT)
    if hot is None:
        return trie_join(keyed, BUDGET, BITS)
    first = checkpoint(trie_join(dealt(keyed, hot), BUDGET, BITS))
    apart = rest(keyed, hot, first, HOT)
    return first if apart is None else first.union(trie_join(apart, BUDGET, BITS))


def short_links(nodes: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links that connect nodes(node, n, set) whose sets are alike; found by their first shingles, which pairs so alike share.

    First are the smallest hashes; where that makes hot keys, shingles that many sets have
    come last, the most frequent at the end, so that few but near copies are left under hot keys.
    """

    def starts(common, n):
        def run(batches):
            for b in batches:
                sets = b.column("set").to_pylist()
                if not sets:
                    continue
                sizes = np.array([len(x) // 8 for x in sets])
                first = sizes if common is None else _prefix(sizes, similarity)
                flat = np.frombuffer(b"".join(sets), np.int64)
                if common is not None and len(common.value):
                    at = np.minimum(np.searchsorted(common.value, flat), len(common.value) - 1)
                    many = np.where(common.value[at] == flat, n.value[at], 0)
                    flat = flat[np.lexsort((flat, many, np.repeat(np.arange(len(sets)), sizes)))]
                at = np.cumsum(sizes) - sizes
                row = np.repeat(np.arange(len(sets)), first)
                key = flat[at[row] + np.arange(len(row)) - (np.cumsum(first) - first)[row]]
                rows = [pa.array(key)] if common is None else [pa.array(key), b.column("node").take(pa.array(row)), b.column("set").take(pa.array(row))]
                yield pa.RecordBatch.from_arrays(rows, ["key", "node", "set"][: len(rows)])

        return run

    def keyed_by(rows: list) -> DataFrame:
        common = [np.array(x, np.int64) for x in zip(*sorted((r["key"], r["n"]) for r in rows))] or [np.zeros(0, np.int64)] * 2
        send = nodes.sparkSession.sparkContext.broadcast
        return map_arrow(nodes.select("node", "set"), starts(*map(send, common)), "key long, node long, set binary")

    def linked(keyed: DataFrame) -> DataFrame:
        return map_arrow(keyed.repartition("key").sortWithinPartitions("key"), _verified(similarity), "a long, b long")

    sums = nodes.agg(F.sum("n").alias("all"), F.sum(F.col("n") - F.ceil(F.lit(similarity) * F.col("n") - 1e-9) + 1).alias("first")).first()
    keyed = keyed_by([])
    if hot_keys(keyed.select("key"), int(sums["first"] or 0), WHOLE) is not None:
        every = hot_keys(map_arrow(nodes.select("node", "set"), starts(None, None), "key long"), int(sums["all"]), WHOLE)
        keyed = keyed_by(every.select("key", "n").collect() if every is not None else [])  # at most MAX_HOT
    hot = hot_keys(keyed.select("key"), int(sums["first"] or 0), WHOLE)
    if hot is None:
        return linked(keyed)
    first = checkpoint(linked(dealt(keyed, hot)))
    apart = rest(keyed, hot, first, WHOLE)
    return first if apart is None else first.union(linked(apart))


def wide_links(texts: DataFrame, proposed: DataFrame, nodes: DataFrame, size: int, similarity: float) -> DataFrame:
    """(a, b): of proposed(node, component), the links that exact sets confirm. One of each node's texts(doc_id, _h, text) is read again."""
    members = checkpoint(proposed.join(nodes.select("node", "first", "mins"), "node").select(F.col("component").alias("key"), "node", "mins", F.col("first.doc_id").alias("_id"), F.col("first._h").alias("_t")))
    n = members.count()

    def linked(rows: DataFrame, count: int) -> DataFrame:
        held = bitmap(rows.select(F.xxhash64("_id", "_t").alias("_w")), "_w", count, MAX_BITS)
        wanted = texts.sparkSession.sparkContext.broadcast(held)
        sets = shingle_sets(texts.withColumn("_w", F.xxhash64("doc_id", "_h")), size, wanted=wanted).select("doc_id", "_h", "set").dropDuplicates(["doc_id", "_h"])
        together = rows.join(sets, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_t") == F.col("_h"))).select("key", "node", "set", *[c for c in rows.columns if c == "group"])
        return map_arrow(together.repartition("key").sortWithinPartitions("key"), _verified(similarity), "a long, b long")

    hot = hot_keys(members.select("key"), n, WHOLE)
    if hot is None:
        return linked(members.drop("mins"), n)
    marked = _marked(members, hot)
    by_mins = marked.where("n is not null").withColumn("key", F.explode(F.transform("mins", lambda m, i: F.xxhash64(F.col("key"), m, i)))).drop("mins", "n", "parts")
    again = hot_keys(by_mins.select("key"), MINS * n, WHOLE)
    first = linked(marked.where("n is null").drop("mins", "n", "parts").union(dealt(by_mins, again)), n)
    if again is None:
        return first
    first = checkpoint(first)
    apart = rest(by_mins, again, first, WHOLE)
    return first if apart is None else first.union(linked(apart, n))


def similar(docs: DataFrame, size: int = SIZE, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, _h, component): for each row its id, its text's hash and its group; groups are named by a node."""
    limit = math.floor(SHORT / similarity + 1e-9)  # a short text's partners have no more shingles
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("_h"), F.col("text").cast("string").alias("text"))
    prints = checkpoint(shingle_sets(texts, size, limit))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_h")).alias("first")
    nodes = checkpoint(prints.groupBy("node").agg(F.min("n").alias("n"), F.min("fingerprint").alias("fingerprint"), F.min("mins").alias("mins"), F.min("set").alias("set"), least))
    wide = nodes.where(F.col("n") > SHORT)
    checked = wide_links(texts, connected_components(proposals(wide)), wide, size, similarity)
    short = short_links(nodes.where(F.col("n").between(1, limit)), similarity)
    found = connected_components(checked.union(short))
    return prints.select("doc_id", "_h", "node").join(found, "node", "left").select("doc_id", "_h", F.coalesce("component", "node").alias("component"))


def keep_one(docs: DataFrame, size: int = SIZE, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each group, with all its columns: that with the smallest doc_id, rows without one last, and of several texts under it that with the smallest hash."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64(F.col("text").cast("string")).alias("_h"))
    found = similar(docs, size, similarity)
    leaders = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_h")).alias("l")).select(F.col("l.doc_id").alias("_lead"), F.col("l._h").alias("_lead_h"))
    one = rows.dropDuplicates(["_id", "_h"])  # rows repeated whole, combined before they move
    return one.join(leaders, F.col("_id").eqNullSafe(F.col("_lead")) & (F.col("_h") == F.col("_lead_h")), "left_semi").select("row.*")
