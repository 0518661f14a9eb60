"""Token counts under a unigram vocabulary, by dynamic programming over a trie of pre-tokens.

A text is cut at white space into pre-tokens, each led by the word mark. A pre-token's
segmentation is the one of highest total score (ties: fewer tokens). Best scores of a
prefix do not depend on what follows, so the distinct pre-tokens of a task go into a trie
and the forward scores are computed once for each trie node: all nodes of one depth
together, from the scores of their ancestors. Counts are read at terminal nodes, kept for
later batches of the same Python worker, and summed for each document. Rows are not shuffled.

Vocabulary: the pieces of a sentencepiece model, with the unigram score
-log(rank + 2) by position in the file. Characters outside it fall back to one token for
each UTF-8 byte, at a score below any piece.

Defined cases: null or blank text has 0 tokens; repeated rows are counted once each; an
empty table gives no rows; other columns are ignored. A pre-token longer than LONGEST
characters, of which there are few, is scored without the trie, in windows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import chunks, keep, map_arrow, mix

MARK = "▁"
BYTE_SCORE = -25.0  # for each byte of a character outside the vocabulary; pieces score above -12
CACHE = 600_000  # pre-tokens of at most LONGEST characters whose counts a Python worker keeps
LONGEST = 64


def vocabulary(path: str) -> dict[str, float]:
    """piece -> score; control, unknown and byte pieces are left out."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    return {m.id_to_piece(i): -math.log(i + 2) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))}


class TrieCounter:
    """Counts of pre-tokens by depth-synchronous forward scores over their trie."""

    def __init__(self, vocab: dict[str, float]) -> None:
        self.pieces = vocab
        self.longest = max(map(len, vocab), default=1)
        self.seen: dict[str, int] = {}
        lengths = sorted({len(p) for p in vocab})
        # for each length, the sorted hashes of its pieces and their scores
        self.tables = []
        for n in lengths:
            own = [p for p in vocab if len(p) == n]
            codes = np.frombuffer("".join(own).encode("utf-32-le"), "<u4").reshape(-1, n)
            h = self._fold(codes)
            order = np.argsort(h)
            self.tables.append((n, h[order], np.array([vocab[p] for p in own])[order]))

    @classmethod
    def get(cls, path: str) -> TrieCounter:
        kept = keep(__name__)
        if path not in kept:
            kept[path] = cls(vocabulary(path))
        return kept[path]

    @staticmethod
    def _fold(codes: np.ndarray) -> np.ndarray:
        """A polynomial hash of each row of code points."""
        h = np.zeros(len(codes), np.uint64)
        for j in range(codes.shape[1]):
            h = h * np.uint64(0x9E3779B97F4A7C15) + mix(codes[:, j].astype(np.uint64))
        return h

    def counts(self, words: list[str]) -> list[int]:
        """Tokens of distinct words of at most LONGEST characters, each without its mark."""
        if not words:
            return []
        marked = sorted(MARK + w for w in words)
        size = np.array([len(w) for w in marked])
        depth_max = int(size.max())
        codes = np.zeros((len(marked), depth_max), np.uint32)
        flat = np.frombuffer("".join(marked).encode("utf-32-le"), "<u4")
        codes[np.repeat(np.arange(len(marked)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
        # node[d][w]: the trie node of word w at depth d, numbered within the depth; sorted words make prefixes adjacent
        live = np.arange(len(marked))
        node = [np.zeros(len(marked), np.int64)]
        rep: list[np.ndarray] = [np.zeros(1, np.int64)]  # a word that runs through each node
        score, tokens = [np.zeros(1)], [np.zeros(1, np.int64)]
        total = np.zeros(len(marked), np.int64)
        new_prefix = np.zeros(len(marked), bool)
        new_prefix[0] = True
        power, prefix = np.uint64(0x9E3779B97F4A7C15), [np.zeros(1, np.uint64)]
        pw = [np.uint64(pow(int(power), n, 2**64)) for n in range(self.longest + 1)]
        for d in range(1, depth_max + 1):
            c = codes[:, d - 1]
            new_prefix[1:] |= c[1:] != c[:-1]
            live = live[size[live] >= d]
            first = np.zeros(len(live), bool)
            if len(live):
                # a node starts where any character up to here differs from that of the previous live word
                gaps = np.add.reduceat(new_prefix, np.append(0, live[:-1] + 1))[: len(live)] if len(live) > 1 else np.array([1])
                first = gaps > 0
                first[0] = True
            own = np.cumsum(first) - 1
            at = np.full(len(marked), -1, np.int64)
            at[live] = own
            heads = live[first]
            node.append(at)
            rep.append(heads)
            prefix.append(prefix[d - 1][node[d - 1][heads]] * power + mix(c[heads].astype(np.uint64)))
            best, fewest = np.full(len(heads), -np.inf), np.zeros(len(heads), np.int64)
            single = np.zeros(len(heads), bool)
            for n, hashes, scores in self.tables:
                if n > d:
                    break
                from_ = node[d - n][heads]
                h = prefix[d] - prefix[d - n][from_] * pw[n]
                i = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                ok = hashes[i] == h
                single |= ok if n == 1 else False
                s = np.where(ok, score[d - n][from_] + scores[i], -np.inf)
                t = tokens[d - n][from_] + 1
                better = (s > best) | ((s == best) & ok & (t < fewest))
                best, fewest = np.where(better, s, best), np.where(better, t, fewest)
            # the byte fallback is open to characters that are no piece
            cp = c[heads]
            width = 1 + (cp > 0x7F) + (cp > 0x7FF) + (cp > 0xFFFF)
            up = node[d - 1][heads]
            s, t = score[d - 1][up] + BYTE_SCORE * width, tokens[d - 1][up] + width
            better = ~single & ((s > best) | ((s == best) & (t < fewest)))
            score.append(np.where(better, s, best))
            tokens.append(np.where(better, t, fewest))
            ends = live[size[live] == d]
            total[ends] = tokens[d][at[ends]]
        found = dict(zip(marked, total.tolist()))
        return [found[MARK + w] for w in words]

    def long_count(self, word: str) -> int:
        """Tokens of one word of any length: the plain forward recursion with a window of the longest piece."""
        text, window = MARK + word, [(0.0, 0)]
        for d in range(1, len(text) + 1):
            best, fewest = -math.inf, 0
            for n in range(1, min(self.longest, d) + 1):
                piece = self.pieces.get(text[d - n : d])
                if piece is not None:
                    s, t = window[-n][0] + piece, window[-n][1] + 1
                    if s > best or s == best and t < fewest:
                        best, fewest = s, t
            if text[d - 1] not in self.pieces:
                width = len(text[d - 1].encode("utf-8", "surrogatepass"))
                s, t = window[-1][0] + BYTE_SCORE * width, window[-1][1] + width
                if s > best or s == best and t < fewest:
                    best, fewest = s, t
            window = [*window[-self.longest :], (best, fewest)]
        return window[-1][1]

    def documents(self, texts: list[str]) -> tuple[list[int], list[int]]:
        """Tokens and pre-tokens of each text."""
        split = [t.split() for t in texts]
        seen = self.seen
        new = {w for s in split for w in s if w not in seen}
        if len(seen) + len(new) > CACHE:
            seen.clear()
            new = {w for s in split for w in s}
        short = [w for w in new if len(w) <= LONGEST]
        for at in range(0, len(short), 50_000):
            part = short[at : at + 50_000]
            seen.update(zip(part, self.counts(part)))
        for w in new:
            if len(w) > LONGEST:
                seen[w] = self.long_count(w)
        found = [sum([seen[w] for w in s]) for s in split], [len(s) for s in split]
        for w in new:
            if len(w) > LONGEST:
                del seen[w]
        return found


def token_counts(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_pretokens, n_tokens) for every document."""

    def run(batches):
        counter = TrieCounter.get(model)
        for part in chunks(batches, "text"):
            tokens, words = counter.documents([t or "" for t in part.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_pretokens", "n_tokens"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, n_pretokens long, n_tokens long")
