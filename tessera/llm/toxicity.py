"""Toxicity: a weighted lexicon matched by Aho-Corasick after folding look-alike characters.

Before all else combining marks and invisible format characters are dropped, and each run of
white space becomes one blank. Folding maps each character to one character: lower case, accents off, look-alike letters
of other scripts and full-width forms to Latin, and digits and signs to the letters they
stand for. Matches must be whole words of the text before folding, and matches inside an
exception phrase do not count.

Learning, from labelled training rows only: a term's weight is its log-odds between toxic
and other documents; to the base list come words that the labels prove (a z-score of at least MIN_Z, in at least MIN_SHARE of toxic texts). A logistic model turns the weighted hits, alone and for each hundred words, into
a score. It is fitted on at most SAMPLE labelled rows, picked by a hash of doc_id. At most
MAX_LEARNED words are learned, of 3 to 40 letters. Every document is scored, over its whole text.

Defined cases: null and empty texts have no hits and get the model's lowest score; a
null doc_id is scored and counts as not held out; several labels of one document count
as toxic if one does; without labels of both kinds the base weights and a fixed model
are used; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import chunks, map_arrow

SAMPLE = 20_000  # labelled rows that the weights and the model are fitted on, at most
MAX_LEARNED = 2_000  # learned terms, at most
MIN_SUPPORT, MIN_SHARE, MIN_Z = 5, 0.02, 6.0
BASE_WEIGHT = 3.0
FIXED_MODEL = (-3.0, 1.0, 0.3)  # bias, log of weighted hits, weighted hits per hundred words

# Common insults, and harmless phrases that hold one.
BASE_TERMS = """
abruti abschaum arschloch asshole basura bastard bitch clown connard creep cretin crétin disgusting dumb dummkopf
estúpido fool freak garbage idiot idiota idiote imbecile imbécil imbécile jerk loser moron ordure pathetic
salaud scum scumbag shit stupid stupide trash trottel vermin worthless
""".split()
EXCEPTIONS = ["class clown", "clown car", "clown fish", "clown nose", "fool proof", "garbage bin", "garbage can", "garbage collection", "garbage collector", "garbage truck", "trash bag", "trash bin", "trash can", "trash collection"]
LOOKALIKES = str.maketrans("авекмнорстухіјѕԁɡᴏαβεικνορτυχ0134578@$!|€", "abekmhopctyxijsdgoabeikvoptuxoieastbasiie")


def _table() -> dict[int, str]:
    fold = {ord(a): chr(b) if isinstance(b, int) else b for a, b in ((chr(k), v) for k, v in LOOKALIKES.items())}
    for c in [*range(0xC0, 0x250), *range(0xFF01, 0xFF5F), *range(0x370, 0x530)]:
        base = unicodedata.normalize("NFKD", chr(c))[0].lower()
        if len(base) == 1 and base != chr(c):
            fold[c] = fold.get(ord(base), base)
    for c in range(65, 91):
        fold[c] = chr(c + 32)
    return fold


FOLD = _table()


# Combining marks and format characters of the blocks that Latin, Greek and Cyrillic text meets.
_DROP = re.compile("[\u00ad\u0300-\u036f\u0483-\u0489\u061c\u180e\u1ab0-\u1aff\u1dc0-\u1dff\u200b-\u200f\u202a-\u202e\u2060-\u206f\u20d0-\u20ff\ufe00-\ufe0f\ufe20-\ufe2f\ufeff]+")


def plain(text: str) -> tuple[str, int]:
    """The text without combining marks and format characters, its words parted by one blank; and how many words it has."""
    words = (text if text.isascii() else _DROP.sub("", text)).split()
    return " ".join(words), len(words)


def fold(text: str) -> str:
    """The text with each character folded; as long as before."""
    return text.translate(FOLD)


@dataclass(frozen=True)
class Lexicon:
    """Weights of folded terms and the logistic model over their hits."""

    weights: dict[str, float]
    model: tuple[float, float, float] = FIXED_MODEL
    exceptions: tuple[str, ...] = tuple(EXCEPTIONS)

    def matcher(self):
        """A function from a text to its weighted hits, number of hits and number of words."""
        machine = ahocorasick.Automaton()
        for t, w in self.weights.items():
            machine.add_word(fold(t), (len(t), w))
        for t in self.exceptions:
            machine.add_word(fold(t), (len(t), None))
        if len(machine):
            machine.make_automaton()

        def match(text: str) -> tuple[float, int, int]:
            text, words = plain(text)
            found, masked = [], []
            if len(machine):
                for end, (n, w) in machine.iter(fold(text)):
                    s, e = end + 1 - n, end + 1
                    if (s and text[s - 1].isalnum()) or (e < len(text) and text[e].isalnum()):
                        continue
                    (masked if w is None else found).append((s, e, w))
            if masked:
                found = [x for x in found if not any(s <= x[0] and x[1] <= e for s, e, _ in masked)]
            return sum(w for _, _, w in found), len(found), words

        return match

    def score(self, hits: np.ndarray, words: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features(hits, words) @ np.array(self.model), -30, 30)))


def features(hits: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(hits)), np.log1p(hits), np.minimum(100 * hits / np.maximum(words, 20), 50)], axis=1)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, ...]:
    """Logistic regression by Newton steps."""
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(beta)), x.T @ (y - p) - ridge * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, beta))


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of at most SAMPLE training rows. Their ids are few enough to broadcast whatever the input."""
    train = labels.where("toxic is not null and doc_id is not null").where(~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    n = train.count()
    share = min(1.0, 0.95 * SAMPLE / max(n, 1))
    picked = train.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20))).limit(SAMPLE)
    rows = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(picked), "doc_id")
    # copies of one text prove no more than the text itself
    one = rows.groupBy(F.xxhash64("text").alias("_h")).agg(F.max_by(F.struct("text", "toxic"), F.struct("toxic", -F.col("doc_id"))).alias("r"))
    # an id may stand for many texts: of these, the share that keeps the sample within its bound
    total = one.count()
    return one.where(F.pmod(F.xxhash64("_h"), F.lit(1 << 20)) < int(min(1.0, SAMPLE / max(total, 1)) * (1 << 20))).select("r.*")


def learn(docs: DataFrame, labels: DataFrame) -> Lexicon:
    """Weights and model from the labelled rows that are not held out."""
    sample = _sample(docs, labels)

    def words(batches):
        for b in batches:
            tox, text = [], []
            for t, y in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
                own = {w for w in "".join(c if c.isalpha() else " " for c in fold(plain(t or "")[0])).split() if 3 <= len(w) <= 40}
                text += own
                tox += [y] * len(own)
                text.append("")  # counts the documents
                tox.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(text, pa.string()), pa.array(tox, pa.int32())], ["word", "toxic"])

    counts = map_arrow(sample, words, "word string, toxic int").groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    # documents of each kind and the base terms, then the best-proven words: a bounded list
    base = {fold(t): BASE_WEIGHT for t in BASE_TERMS}
    known = {r["word"]: (r["t"], r["c"]) for r in counts.where(F.col("word").isin("", *base)).collect()}
    nt, nc = known.get("", (0, 0))
    if not nt or not nc:
        return Lexicon(base)
    p, q = (F.col("t") + 0.5) / (nt + 1), (F.col("c") + 0.5) / (nc + 1)
    pooled = (F.col("t") + F.col("c") + 1) / (nt + nc + 2)
    z = (p - q) / F.sqrt(pooled * (1 - pooled) * (1 / nt + 1 / nc))
    odds = F.log(p / (1 - p)) - F.log(q / (1 - q))
    proven = counts.where(f"word <> '' and t >= {max(MIN_SUPPORT, MIN_SHARE * nt)}").withColumn("z", z).withColumn("w", odds).where((F.col("z") >= MIN_Z) & (F.col("w") >= 1.5))
    weights = dict(base)
    for w, (t, c) in known.items():
        if w and t + c >= MIN_SUPPORT:  # labels overrule the base weight, down to nothing
            weights[w] = max(0.0, float(np.log((t + 0.5) / (nt - t + 0.5)) - np.log((c + 0.5) / (nc - c + 0.5))))
    weights |= {r["word"]: r["w"] for r in proven.orderBy(F.desc("z"), "word").limit(MAX_LEARNED).select("word", "w").collect()}
    lexicon = Lexicon({w: round(x, 6) for w, x in weights.items() if x > 0})
    fitted = _matched(sample.select(F.col("toxic").cast("long").alias("doc_id"), "text"), lexicon).toPandas()  # at most SAMPLE rows
    model = fit(features(fitted["hits"].to_numpy(float), fitted["words"].to_numpy(float)), fitted["doc_id"].to_numpy(float))
    return Lexicon(lexicon.weights, model)


def _matched(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    def run(batches):
        match = lexicon.matcher()
        for b in chunks(batches, "text"):
            found = [match(t or "") for t in b.column("text").to_pylist()]
            hits, n, words = map(list, zip(*found)) if found else ([], [], [])
            score = lexicon.score(np.array(hits, float), np.array(words, float)) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score), pa.array(hits, pa.float64()), pa.array(n, pa.int64()), pa.array(words, pa.int64())], ["doc_id", "score", "hits", "n_hits", "words"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, score double, hits double, n_hits long, words long")


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, held_out, score, predicted, hits, n_hits, words) for every document."""
    return _matched(docs, lexicon).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "hits", "n_hits", "words")


def drop_toxic(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Documents that are not predicted toxic, with all their columns; no shuffle."""

    def run(batches):
        match = lexicon.matcher()
        for b in chunks(batches, "text"):
            found = [match(t or "") for t in b.column("text").to_pylist()]
            score = lexicon.score(np.array([x[0] for x in found], float), np.array([x[2] for x in found], float))
            yield b.filter(pa.array(score < 0.5))

    return map_arrow(docs, run, docs.schema)
