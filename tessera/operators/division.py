"""Documents in a context: relational division of dt by a set of terms."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import bitmaps

IN_LIST_MAX = 1000  # a context up to this size is an IN list, pushed down to the scan


def _context(terms: Iterable) -> list:
    found = list(dict.fromkeys(terms))
    if not found:
        raise ValueError("a context needs at least one term")
    return found


def docs_in_context(dt: DataFrame, terms: Iterable | DataFrame) -> DataFrame:
    """doc of every document that holds all terms; one scan and one aggregate at any context size.

    terms: ids, or a DataFrame with a term column. Repeated terms count once; an unknown
    term gives no rows; an empty context raises ValueError.
    """
    if isinstance(terms, DataFrame):
        ctx = terms.select("term").where("term is not null").distinct()
        n = ctx.count()
        if not n:
            raise ValueError("a context needs at least one term")
        hits = dt.join(ctx, "term", "left_semi")
    else:
        found = _context(terms)
        n = len(found)
        if n > IN_LIST_MAX:
            ctx = dt.sparkSession.createDataFrame([(t,) for t in found], dt.select("term").schema)
            hits = dt.join(ctx, "term", "left_semi")
        else:
            hits = dt.where(F.col("term").isin(found))
    # dt is unique on (doc, term); countDistinct keeps the result right for bags too
    count = F.count("*") if n == 1 else F.countDistinct("term")
    return hits.groupBy("doc").agg(count.alias("_n")).where(F.col("_n") >= n).select("doc")


def count_docs_in_context(dt: DataFrame, terms: Iterable | DataFrame) -> DataFrame:
    return docs_in_context(dt, terms).agg(F.count("*").alias("n"))


def posting_bitmaps(dt: DataFrame) -> DataFrame:
    """(key, bucket, bits): documents of each term as bitmaps."""
    return bitmaps.from_rows(dt, "term", "doc", sparse=True)


def count_docs_in_context_bitmap(postings: DataFrame, terms: Iterable) -> DataFrame:
    """The count of docs_in_context over posting_bitmaps: AND per bucket, then a popcount sum."""
    return bitmaps.all_of(postings, _context(terms)).agg(F.coalesce(F.sum(F.expr("bitmap_count(bits)")), F.lit(0)).alias("n"))


def rows_in_context(rows: DataFrame, words: str, terms: Iterable) -> DataFrame:
    """Rows of documents whose array column of words holds all terms: a filter, where a document is one row."""
    return rows.where(reduce(lambda a, b: a & b, (F.array_contains(words, t) for t in _context(terms))))


def docs_in_context_by_year(dt: DataFrame, dy: DataFrame, terms: Iterable) -> DataFrame:
    return docs_in_context(dt, terms).join(dy, "doc").groupBy("year").agg(F.count("*").alias("n"))


def docs_with_year(dt: DataFrame, dy: DataFrame, terms: Iterable) -> DataFrame:
    return docs_in_context(dt, terms).join(dy, "doc").select("doc", "year")
