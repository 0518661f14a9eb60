"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations only.

Texts are lower-cased and cut into runs of letters and digits. A seed is a fixed mask over
consecutive tokens: the hash of the tokens at its kept positions ignores those between, so
a passage with substituted words still shares some seeds. Seeds of benchmark items and of
documents are joined; around each hit both texts are laid side by side, and the aligned
tokens within REACH of the hit are compared. An overlap counts if at least SHARE of them,
and at least LEAST, agree; or if SHARE of any RUN aligned tokens that take in the hit's first
one agree, so that a passage quoted from within an item counts whatever surrounds it.

Positions are generated, hashed and looked up inside one generated-code stage: a document
is not shuffled, only hits leave it. The seed table of the benchmark is broadcast if it has
at most BROADCAST_SEEDS rows (checked). Beyond that the seeds of documents are shuffled to
those of items, and the hits' documents, known by doc_id and a hash of the text, are read
again and shuffled to their hits: other costs, the same rows. clean() drops documents by a
broadcast of at most BROADCAST_MARKS ids (checked), and by a shuffle beyond that.

Items shorter than a mask's span are found through the hash of all their tokens. Their
lengths add masks of their own, so each length that occurs adds one.

Defined cases: null or token-free texts and items match nothing; an item of fewer than
LEAST_ITEM tokens is too short to tell and is ignored; repeated rows and copies are each
found; rows that share a doc_id, or have none, are reported as one, by their best alignment,
and dropped each by its own text; empty tables give no rows; other columns are ignored, and
carried along by clean() whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import checkpoint

# Fixed masks of weight 7: offsets of kept tokens.
MASKS = ((0, 1, 2, 3, 4, 5, 6), (0, 1, 3, 4, 7, 8, 10), (0, 2, 3, 5, 6, 9, 11), (0, 1, 4, 6, 7, 9, 12))
REACH = 10  # tokens compared on either side of a hit's first token: 10 before, 15 after
AFTER = 15
RUN = 13  # aligned tokens that are an overlap on their own
SHARE, LEAST, LEAST_ITEM = 0.75, 7, 5
BROADCAST_SEEDS, BROADCAST_MARKS = 500_000, 1_000_000


def tokens(text: Column) -> Column:
    """Hashes of the runs of letters and digits, lower-cased; an array, empty for null."""
    clean = F.trim(F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(clean == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(clean, " "), lambda t: F.xxhash64(t)))


def _seed(h: Column, at: Column, mask: tuple[int, ...], salt: int) -> Column:
    kept = [F.get(h, at + o) for o in mask]
    return F.when(at + mask[-1] < F.size(h), F.xxhash64(F.lit(salt), *kept))


def _masks(lengths: list[int]) -> list[tuple[int, ...]]:
    return [*MASKS, *(tuple(range(n)) for n in lengths)]


def _seeds(rows: DataFrame, masks: list[tuple[int, ...]]) -> DataFrame:
    """One row for each position and mask: the columns of rows(h, ...), pos, seed."""
    spread = rows.select("*", F.posexplode_outer("h").alias("pos", "_t")).drop("_t")
    return spread.select("*", F.explode(F.array(*[_seed(F.col("h"), F.col("pos"), m, i) for i, m in enumerate(masks)])).alias("seed")).where("seed is not null")


def alignments(docs: DataFrame, benchmark: DataFrame, broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """(doc_id, t, item_id, start, length, matched): alignments of documents and items that count as overlaps; t is the hash of the document's text."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), tokens(F.col("text")).alias("item")).where(F.size("item") >= LEAST_ITEM)
    span = max(m[-1] for m in MASKS) + 1
    lengths = [r[0] for r in items.select(F.size("item").alias("n")).where(F.col("n") < span).distinct().orderBy("n").collect()]  # fewer than span values
    masks = _masks([n for n in lengths if n != len(MASKS[0])])
    seeds = _seeds(items.select("item_id", F.col("item").alias("h")), masks).select("item_id", F.col("pos").alias("q"), "seed").distinct()
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("t"), tokens(F.col("text")).alias("h"))
    table = items.select("item_id", "item")
    if seeds.limit(broadcast_seeds + 1).count() <= broadcast_seeds:
        hits = _seeds(own, masks).join(F.broadcast(seeds), "seed").select("doc_id", "t", "item_id", "h", "pos", "q")
        beside = hits.join(F.broadcast(table), "item_id")
    else:
        hits = _seeds(own, masks).select("doc_id", "t", "pos", "seed").join(seeds, "seed").drop("seed").distinct()
        again = own.select(F.col("doc_id").alias("_d"), F.col("t").alias("_t"), "h")
        beside = hits.join(again, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("t") == F.col("_t"))).drop("_d", "_t").join(table, "item_id")
    # the aligned tokens around the hit that both texts have
    lo = F.greatest(F.col("q") - REACH, F.lit(0), F.col("q") - F.col("pos"))
    hi = F.least(F.col("q") + AFTER, F.size("item") - 1, F.col("q") + F.size("h") - 1 - F.col("pos"))
    near = F.size(F.filter(F.sequence(lo, hi), lambda j: F.get("h", F.col("pos") - F.col("q") + j) == F.get("item", j)))
    around = (F.col("_near") >= F.greatest(F.lit(LEAST_ITEM), F.least(F.lit(LEAST), F.size("item")))) & (F.col("_near") >= SHARE * F.col("_n")) & (F.col("_n") >= F.least(F.lit(LEAST + 3), F.size("item")))
    # runs that take in the hit's first token
    left = F.greatest(F.col("q") - (RUN - 1), F.lit(0), F.col("q") - F.col("pos"))
    right = F.least(F.col("q") + (RUN - 1), F.size("item") - 1, F.col("q") + F.size("h") - 1 - F.col("pos"))
    agree = F.transform(F.sequence(left, right), lambda j: F.get("h", F.col("pos") - F.col("q") + j) == F.get("item", j))
    within = F.exists(F.sequence(F.lit(1), F.size("_agree") - (RUN - 1)), lambda s: F.size(F.filter(F.slice("_agree", s, RUN), lambda x: x)) >= SHARE * RUN)
    run = F.when(F.size("_agree") >= RUN, within).otherwise(False)
    judged = beside.withColumn("_near", near).withColumn("_n", hi - lo + 1).withColumn("_agree", agree).where(around | run)
    start = F.col("pos") - F.col("q")
    first, last = F.greatest(F.lit(0), -start), F.least(F.size("item"), F.size("h") - start) - 1
    whole = F.size(F.filter(F.sequence(first, last), lambda j: F.get("h", start + j) == F.get("item", j)))
    return judged.select("doc_id", "t", "item_id", start.alias("start"), (last - first + 1).alias("length"), whole.alias("matched"))


def overlaps(docs: DataFrame, benchmark: DataFrame, broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """(doc_id, item_id, start, length, matched, share): for each contaminated document and item the best-matching alignment.

    start is the document token that the item's first token is aligned with (it can lie
    before the text), length the aligned tokens that both texts have, matched how many agree.
    """
    found = alignments(docs, benchmark, broadcast_seeds)
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("matched", (-F.col("start")).alias("_s"), "length")).alias("b"))
    return best.select("doc_id", "item_id", (-F.col("b._s")).alias("start"), "b.length", "b.matched", (F.col("b.matched") / F.col("b.length")).alias("share"))


def clean(docs: DataFrame, benchmark: DataFrame, broadcast_marks: int = BROADCAST_MARKS) -> DataFrame:
    """Documents that overlap no benchmark item, with all their columns."""
    marked = checkpoint(alignments(docs, benchmark).select(F.col("doc_id").alias("_bad"), F.col("t").alias("_t")).distinct())
    if marked.limit(broadcast_marks + 1).count() <= broadcast_marks:
        marked = F.broadcast(marked)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64(F.col("text").cast("string")).alias("_h"))
    return rows.join(marked, F.col("_id").eqNullSafe(F.col("_bad")) & (F.col("_h") == F.col("_t")), "left_anti").select("row.*")
