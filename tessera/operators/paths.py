"""Path counts in the author-document-term graph, aggregated after every hop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cooccurrence_count(dt: DataFrame, seed: int) -> DataFrame:
    """(doc, score): terms that each document shares with the seed document, itself included."""
    seeds = dt.where(F.col("doc") == seed).select("term")
    return seeds.join(dt, "term").groupBy("doc").agg(F.count("*").alias("score"))


def cooccurrence_tf(dt: DataFrame, seed: int) -> DataFrame:
    """The same, weighted by the other document's frequency."""
    seeds = dt.where(F.col("doc") == seed).select("term")
    return seeds.join(dt, "term").groupBy("doc").agg(F.sum("freq").alias("score"))


def authors_in_docs(da: DataFrame, docs: DataFrame) -> DataFrame:
    """(author, score): rows of the document bag that each author wrote."""
    return docs.select("doc").join(da, "doc").groupBy("author").agg(F.count("*").alias("score"))


def _hop(counted: DataFrame, edges: DataFrame, on: str, to: str) -> DataFrame:
    return counted.join(edges.select(on, to), on).groupBy(to).agg(F.sum("c").alias("c"))


def author_reach(dt: DataFrame, da: DataFrame, author: int, by_term: DataFrame | None = None) -> DataFrame:
    """(author, score): number of author-doc-term-doc-author paths from one author. by_term: a copy of dt dealt by term, if there is one.

    Counts are summed after each hop, so no intermediate is larger than one row a key
    times the next relation; the plain four-way join would carry every path.
    """
    docs = da.where(F.col("author") == author).groupBy("doc").agg(F.count("*").alias("c"))
    terms = _hop(docs, dt, "doc", "term")
    reached = _hop(terms, dt if by_term is None else by_term, "term", "doc")
    return _hop(reached, da, "doc", "author").withColumnRenamed("c", "score")


def author_reach_paths(dt: DataFrame, da: DataFrame, author: int) -> DataFrame:
    """The four-way join form: the same rows, kept as a cross-check."""
    d1 = da.where(F.col("author") == author).select("doc")
    mid = d1.join(dt.select("doc", "term"), "doc").select("term").join(dt.select("term", "doc"), "term").select("doc")
    return mid.join(da, "doc").groupBy("author").agg(F.count("*").alias("score"))
