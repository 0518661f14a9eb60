"""Queries of the analytics engine, each with the SQL that must give the same rows."""

from __future__ import annotations

import os
from collections.abc import Callable
from string import Template

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import bitmaps, division, encode, paths, sets, topk
from tessera.shared import new_folder
from tessera.sources import containers, generators, histograms, layout
from tessera.sources.relations import load_da, load_dt, load_dy, load_tokens, load_words, table

# Query parameters: the two-term context with most documents and the largest document of each scale.
PARAMETERS = {
    "sf0.001": {"context": (29, 42), "seed": 1102, "author": 7},
    "sf0.01": {"context": (260, 625), "seed": 56, "author": 7},
    "sf0.1": {"context": (2354, 12089), "seed": 9988, "author": 7},
}
WORDS = ("the", "and", "of")
K = 5


def parameters(sf_dir: str) -> dict:
    return PARAMETERS.get(os.path.basename(sf_dir.rstrip("/")), PARAMETERS["sf0.01"])


def _bag(spark: SparkSession, d: str) -> DataFrame:
    """A document list that grows with the table: urgent orders, those in progress twice."""
    urgent = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'")
    return urgent.select(F.col("o_orderkey").alias("doc")).union(urgent.where("o_orderstatus = 'P'").select("o_orderkey"))


def _holding(spark: SparkSession, d: str, dt: DataFrame, sizes: str) -> DataFrame:
    """(doc), a bag: documents with a term whose part has such a size."""
    terms = table(spark, d, "part").where(sizes).select(F.col("p_partkey").alias("term"))
    return dt.join(terms, "term", "left_semi").select("doc")


SMALL, MIDDLE, NOT_LEAST = "p_size <= 5", "p_size BETWEEN 4 AND 9", "p_size >= 3"

DT = "dt AS (SELECT l_orderkey AS doc, l_partkey AS term, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS freq FROM lineitem GROUP BY 1, 2)"
DA = "da AS (SELECT DISTINCT l_orderkey AS doc, l_suppkey AS author FROM lineitem)"
DY = "dy AS (SELECT o_orderkey AS doc, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders)"
TOK = "tok AS (SELECT doc, term, count(*) AS freq FROM (SELECT doc_id AS doc, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM documents) GROUP BY 1, 2)"
CTX = "ctx AS (SELECT doc FROM dt WHERE term IN ($context) GROUP BY doc HAVING count(DISTINCT term) = 2)"
DOCS = "docs AS (SELECT o_orderkey AS doc FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P')"
A = f"a AS (SELECT DISTINCT doc FROM dt WHERE term IN (SELECT p_partkey FROM part WHERE {SMALL}))"
B = f"b AS (SELECT DISTINCT doc FROM dt WHERE term IN (SELECT p_partkey FROM part WHERE {MIDDLE}))"
TOP = f"GROUP BY term ORDER BY score DESC, term LIMIT {K}"


def _with(*parts: str) -> str:
    *ctes, body = parts
    return f"WITH {', '.join(ctes)} {body}"


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}  # with $context, $seed, $author and $term where parameters go


def oracles(sf_dir: str) -> dict[str, str]:
    """The SQL of every query with the parameters of a scale."""
    own = parameters(sf_dir)
    values = {"context": ", ".join(map(str, own["context"])), "seed": own["seed"], "author": own["author"], "term": own["context"][1]}
    return {name: Template(sql).substitute(values) for name, sql in _SQL.items()}


def _query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return register


@_query("docs_in_context", _with(DT, CTX, "SELECT doc FROM ctx"))
def docs_in_context(spark, d):
    return division.docs_in_context(load_dt(spark, d), parameters(d)["context"])


@_query("count_docs_in_context", _with(DT, CTX, "SELECT count(*) AS n FROM ctx"))
def count_docs_in_context(spark, d):
    return division.count_docs_in_context(load_dt(spark, d), parameters(d)["context"])


@_query("docs_in_context_bitmap", _with(DT, CTX, "SELECT count(*) AS n FROM ctx"))
def docs_in_context_bitmap(spark, d):
    ctx = parameters(d)["context"]
    return division.count_docs_in_context_bitmap(division.posting_bitmaps(load_dt(spark, d).where(F.col("term").isin(*ctx))), ctx)


@_query("docs_in_context_tokens", _with(TOK, "SELECT doc FROM tok WHERE term IN ('the', 'and', 'of') GROUP BY doc HAVING count(DISTINCT term) = 3"))
def docs_in_context_tokens(spark, d):
    return division.rows_in_context(load_words(spark, d, WORDS), "words", WORDS).select("doc")


@_query("topk_terms_in_docs", _with(DT, DOCS, f"SELECT term, count(*) AS score FROM docs JOIN dt USING (doc) {TOP}"))
def topk_terms_in_docs(spark, d):
    dt = load_dt(spark, d)
    return topk.topk_terms(dt, _bag(spark, d), K)


@_query("topk_terms_in_context", _with(DT, CTX, f"SELECT term, count(*) AS score FROM ctx JOIN dt USING (doc) {TOP}"))
def topk_terms_in_context(spark, d):
    return topk.topk_terms_in_context(load_dt(spark, d), parameters(d)["context"], K)


@_query("topk_tf_in_docs", _with(DT, DOCS, f"SELECT term, CAST(sum(freq) AS BIGINT) AS score FROM docs JOIN dt USING (doc) {TOP}"))
def topk_tf_in_docs(spark, d):
    dt = load_dt(spark, d)
    return topk.topk_tf(dt, _bag(spark, d), K)


@_query("topk_tf_in_doc_set", _with(DT, DOCS, f"SELECT term, CAST(sum(freq) AS BIGINT) AS score FROM dt WHERE doc IN (SELECT doc FROM docs) {TOP}"))
def topk_tf_in_doc_set(spark, d):
    dt = load_dt(spark, d)
    return topk.topk_tf_set(dt, _bag(spark, d), K)


@_query("topk_tf_in_context", _with(DT, CTX, f"SELECT term, CAST(sum(freq) AS BIGINT) AS score FROM ctx JOIN dt USING (doc) {TOP}"))
def topk_tf_in_context(spark, d):
    return topk.topk_tf_in_context(load_dt(spark, d), parameters(d)["context"], K)


@_query("topk_tf_in_context_tokens", _with(TOK, f"SELECT term, CAST(sum(freq) AS BIGINT) AS score FROM tok WHERE doc IN (SELECT doc FROM tok WHERE term IN ('the', 'and', 'of') GROUP BY doc HAVING count(DISTINCT term) = 3) {TOP}"))
def topk_tf_in_context_tokens(spark, d):
    return topk.topk_words_in_context(load_words(spark, d, WORDS), "words", WORDS, K)


@_query("topk_tf_dual_list", _SQL["topk_tf_in_docs"])
def topk_tf_dual_list(spark, d):
    dt = load_dt(spark, d)
    return topk.topk_tf_dual_list(topk.dual_lists(dt), _bag(spark, d), K)


@_query("topk_with_ties", _with(DT, f"SELECT term, score FROM (SELECT term, count(*) AS score, rank() OVER (ORDER BY count(*) DESC) AS r FROM dt GROUP BY term) WHERE r <= {K}"))
def topk_with_ties(spark, d):
    counts = load_dt(spark, d).groupBy("term").agg(F.count("*").alias("score"))
    return topk.topk_with_ties(counts, "term", "score", K)


@_query("tf_sum_per_term", _with(DT, DOCS, "SELECT term, CAST(sum(freq) AS BIGINT) AS score FROM docs JOIN dt USING (doc) GROUP BY term"))
def tf_sum_per_term(spark, d):
    dt = load_dt(spark, d)
    return topk.tf_sum_per_term(dt, _bag(spark, d))


@_query("dense_term_counts", _with(DT, CTX, "SELECT p_partkey AS term, count(dt.doc) AS score FROM part LEFT JOIN (SELECT * FROM dt WHERE doc IN (SELECT doc FROM ctx)) dt ON p_partkey = dt.term GROUP BY 1"))
def dense_term_counts(spark, d):
    dt = load_dt(spark, d)
    counts = topk.term_counts(dt, division.docs_in_context(dt, parameters(d)["context"]))
    return topk.dense_counts(counts, table(spark, d, "part").select(F.col("p_partkey").alias("term")), "term")


@_query("cooccurrence_count", _with(DT, "SELECT b.doc, count(*) AS score FROM dt a JOIN dt b ON a.term = b.term WHERE a.doc = $seed GROUP BY b.doc"))
def cooccurrence_count(spark, d):
    return paths.cooccurrence_count(load_dt(spark, d), parameters(d)["seed"])


@_query("cooccurrence_tf", _with(DT, "SELECT b.doc, CAST(sum(b.freq) AS BIGINT) AS score FROM dt a JOIN dt b ON a.term = b.term WHERE a.doc = $seed GROUP BY b.doc"))
def cooccurrence_tf(spark, d):
    return paths.cooccurrence_tf(load_dt(spark, d), parameters(d)["seed"])


@_query("authors_in_docs", _with(DA, DOCS, "SELECT author, count(*) AS score FROM docs JOIN da USING (doc) GROUP BY author"))
def authors_in_docs(spark, d):
    return paths.authors_in_docs(load_da(spark, d), _bag(spark, d))


@_query("author_reach", _with(DT, DA, "SELECT d4.author, count(*) AS score FROM da d1 JOIN dt t1 ON d1.doc = t1.doc JOIN dt t2 ON t1.term = t2.term JOIN da d4 ON t2.doc = d4.doc WHERE d1.author = $author GROUP BY d4.author"))
def author_reach(spark, d):
    return paths.author_reach(load_dt(spark, d), load_da(spark, d), parameters(d)["author"])


def _sets(spark, d):
    dt = load_dt(spark, d)
    return _holding(spark, d, dt, SMALL), _holding(spark, d, dt, MIDDLE), dt.select("doc")


@_query("set_intersect", _with(DT, A, B, "SELECT doc FROM a INTERSECT SELECT doc FROM b"))
def set_intersect(spark, d):
    a, b, _ = _sets(spark, d)
    return sets.intersect(a, b)


@_query("set_intersect_all", _with(DT, A, B, f"SELECT doc FROM a INTERSECT SELECT doc FROM b INTERSECT SELECT doc FROM dt WHERE term IN (SELECT p_partkey FROM part WHERE {NOT_LEAST})"))
def set_intersect_all(spark, d):
    a, b, _ = _sets(spark, d)
    return sets.intersect_all([a, b, _holding(spark, d, load_dt(spark, d), NOT_LEAST)])


@_query("set_keep_members", _with(DT, B, f"SELECT doc FROM dt WHERE term IN (SELECT p_partkey FROM part WHERE {SMALL}) AND doc IN (SELECT doc FROM b)"))
def set_keep_members(spark, d):
    a, b, _ = _sets(spark, d)
    return sets.keep_members(a, b)


@_query("set_union", _with(DT, A, B, "SELECT doc FROM a UNION SELECT doc FROM b"))
def set_union(spark, d):
    a, b, _ = _sets(spark, d)
    return sets.union(a, b)


@_query("set_difference", _with(DT, A, B, "SELECT doc FROM a EXCEPT SELECT doc FROM b"))
def set_difference(spark, d):
    a, b, _ = _sets(spark, d)
    return sets.difference(a, b)


@_query("set_symmetric_difference", _with(DT, A, B, "(SELECT doc FROM a EXCEPT SELECT doc FROM b) UNION (SELECT doc FROM b EXCEPT SELECT doc FROM a)"))
def set_symmetric_difference(spark, d):
    a, b, _ = _sets(spark, d)
    return sets.symmetric_difference(a, b)


@_query("set_complement", _with(DT, A, "SELECT doc FROM dt EXCEPT SELECT doc FROM a"))
def set_complement(spark, d):
    a, _, u = _sets(spark, d)
    return sets.complement(a, u)


@_query("set_cardinality", _with(DT, A, "SELECT count(*) AS n FROM a"))
def set_cardinality(spark, d):
    return sets.cardinality(_sets(spark, d)[0])


@_query("set_append_shifted", _with(DT, A, B, "SELECT doc FROM a UNION SELECT doc + 1000000 FROM b"))
def set_append_shifted(spark, d):
    a, b, _ = _sets(spark, d)
    return sets.append_shifted(a, b, 1_000_000)


@_query("hist_docs_per_term", _with(DT, "SELECT term, count(*) AS n FROM dt GROUP BY term"))
def hist_docs_per_term(spark, d):
    return histograms.docs_per_term(load_dt(spark, d))


@_query("hist_terms_per_doc", _with(DT, "SELECT doc, count(*) AS n FROM dt GROUP BY doc"))
def hist_terms_per_doc(spark, d):
    return histograms.terms_per_doc(load_dt(spark, d))


@_query("hist_docs_per_author", _with(DA, "SELECT author, count(*) AS n FROM da GROUP BY author"))
def hist_docs_per_author(spark, d):
    return histograms.docs_per_author(load_da(spark, d))


@_query("hist_authors_per_doc", _with(DA, "SELECT doc, count(*) AS n FROM da GROUP BY doc"))
def hist_authors_per_doc(spark, d):
    return histograms.authors_per_doc(load_da(spark, d))


@_query("hist_authors_per_doc_skewed", _with(DA, "SELECT doc, CAST(floor(count(*) * 1.75) AS BIGINT) AS n FROM da GROUP BY doc"))
def hist_authors_per_doc_skewed(spark, d):
    return histograms.authors_per_doc(load_da(spark, d), histograms.SCALE_INPUT_SKEW)


def _containers(spark, d) -> str:
    """A folder with the documents of each term as a container, with their frequencies as attributes."""
    path = new_folder(spark, "containers")
    containers.save(load_dt(spark, d).select(F.col("term").alias("id"), F.col("doc").alias("pos"), F.col("doc").alias("element"), F.col("freq").alias("attribute")), path)
    return path


@_query("load_container", _with(DT, "SELECT doc AS element FROM dt WHERE term = $term"))
def load_container(spark, d):
    return containers.elements(containers.load(spark, _containers(spark, d), parameters(d)["context"][1]))


@_query("load_map_column", _with(DT, "SELECT doc AS element, freq AS attribute FROM dt WHERE term = $term"))
def load_map_column(spark, d):
    return containers.load(spark, _containers(spark, d), parameters(d)["context"][1]).select("element", "attribute")


@_query("replace_container", _with(DT, "SELECT term AS id, count(*) AS n, CAST(sum(doc) AS BIGINT) AS total FROM dt WHERE term <> $term GROUP BY term UNION ALL SELECT $term, 3, 12"))
def replace_container(spark, d):
    """All containers after one was replaced by three given values."""
    path, to = _containers(spark, d), new_folder(spark, "containers")
    containers.replace(spark, path, containers.from_values(spark, parameters(d)["context"][1], containers.parse_values("3 3 4 0x5")), to)
    return spark.read.schema(containers.SCHEMA).parquet(to).groupBy("id").agg(F.count("*").alias("n"), F.sum("element").alias("total"))


@_query("hist_group_size", _with(DT, "SELECT count(*) AS n FROM dt WHERE term = $term"))
def hist_group_size(spark, d):
    return histograms.group_size(histograms.docs_per_term(load_dt(spark, d)), "term", parameters(d)["context"][1])


def _flags(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("grp"), F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("ord"), F.when(F.col("l_returnflag") == "N", 1).otherwise(0).cast("long").alias("v"))


@_query(
    "rle_encode",
    "WITH x AS (SELECT l_suppkey AS grp, l_orderkey o, l_linenumber n, l_partkey p, CAST(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END AS BIGINT) AS v FROM lineitem),"
    " y AS (SELECT *, CASE WHEN lag(v) OVER w = v THEN 0 ELSE 1 END AS new FROM x WINDOW w AS (PARTITION BY grp ORDER BY o, n, p)),"
    " z AS (SELECT grp, v, CAST(sum(new) OVER (PARTITION BY grp ORDER BY o, n, p ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM y)"
    " SELECT grp, run, min(v) AS value, count(*) AS run_len FROM z GROUP BY grp, run",
)
def rle_encode(spark, d):
    return encode.rle_encode(_flags(spark, d), "grp", "ord", "v")


@_query("rle_directory", _with(DT, "SELECT term, length, CAST(sum(length) OVER (ORDER BY term) - length AS BIGINT) AS row_id FROM (SELECT term, count(*) AS length FROM dt GROUP BY term)"))
def rle_directory(spark, d):
    return encode.rle_directory(load_dt(spark, d), "term")


@_query("sum_plain", _with(DT, "SELECT CAST(sum(term) AS BIGINT) AS total FROM dt"))
def sum_plain(spark, d):
    return encode.sum_plain(load_dt(spark, d), "term")


@_query("sum_over_rle", _SQL["sum_plain"])
def sum_over_rle(spark, d):
    return encode.sum_over_rle(encode.rle_sorted(load_dt(spark, d), "term"))


@_query("sum_over_runs", _with(DT, "SELECT CAST(sum(freq) AS BIGINT) AS total FROM dt"))
def sum_over_runs(spark, d):
    """Frequencies of each document in term order as runs, summed without decoding."""
    return encode.sum_over_rle(encode.rle_encode(load_dt(spark, d), "doc", "term", "freq"))


@_query("postings_size_report", _with(DT, "SELECT term, count(*) AS n, count(*) * 2 AS bytes2, count(*) * 4 AS bytes4, count(DISTINCT doc // 32768) * 4096 AS bitmap_bytes FROM dt GROUP BY term"))
def postings_size_report(spark, d):
    return encode.postings_size_report(load_dt(spark, d), "term")


def _huffman(symbol: str) -> tuple[str, ...]:
    """CTEs: leaf(symbol, freq) and code(symbol, length) of a column of dt, merging the two least nodes by count, then smallest symbol."""
    return (
        DT,
        f"leaf AS (SELECT {symbol} AS symbol, count(*) AS freq FROM dt GROUP BY 1)",
        "start AS (SELECT list({'n': freq, 's': symbol, 'id': symbol} ORDER BY freq, symbol) AS heap FROM leaf)",
        "merge AS (SELECT 0 AS step, heap, CAST(NULL AS BIGINT) AS a, CAST(NULL AS BIGINT) AS b FROM start UNION ALL"
        " SELECT step + 1, list_sort(list_append(heap[3:], {'n': heap[1].n + heap[2].n, 's': least(heap[1].s, heap[2].s), 'id': -step - 1})), heap[1].id, heap[2].id FROM merge WHERE len(heap) > 1)",
        "up AS (SELECT a AS child, -step AS parent FROM merge WHERE step > 0 UNION ALL SELECT b, -step FROM merge WHERE step > 0)",
        "depth AS (SELECT symbol, symbol AS node, 0 AS d FROM leaf UNION ALL SELECT symbol, parent AS node, d + 1 FROM depth JOIN up ON node = child)",
        "code AS (SELECT symbol, greatest(max(d), 1) AS length FROM depth GROUP BY symbol)",
    )


def _recursive(*parts: str) -> str:
    return _with(*parts).replace("WITH ", "WITH RECURSIVE ", 1)


@_query(
    "huffman_size_estimate",
    _recursive(
        *_huffman("term"),
        "SELECT CAST(sum(freq * 16) AS BIGINT) AS uncompressed_bits, CAST(sum(freq * length) AS BIGINT) AS bits, CAST(sum(freq * ((length + 3) // 4) * 4) AS BIGINT) AS bits_rounded, CAST(sum(freq) AS BIGINT) AS symbols, count(*) AS distinct_symbols, CAST(max(length) AS BIGINT) AS longest FROM code JOIN leaf USING (symbol)",
    ),
)
def huffman_size_estimate(spark, d):
    """The column of terms, from the histogram of documents per term."""
    return encode.huffman_size_estimate(encode.huffman_code_lengths(load_dt(spark, d), "term"))


@_query("huffman_length_histogram", _recursive(*_huffman("term"), "SELECT CAST(length AS BIGINT) AS length, count(*) AS n FROM code GROUP BY 1"))
def huffman_length_histogram(spark, d):
    return encode.huffman_length_histogram(encode.huffman_code_lengths(load_dt(spark, d), "term"))


def _encoded(spark, d):
    """Frequencies of each document in term order, as packed blocks, and their code."""
    dt = load_dt(spark, d)
    codes = encode.huffman_codes(dt, "freq")
    return encode.huffman_encode(dt, codes, "doc", "term", "freq"), codes


@_query("huffman_roundtrip", _with(DT, "SELECT doc, term, freq FROM dt"))
def huffman_roundtrip(spark, d):
    """Frequencies of each document, encoded in term order and decoded again beside their terms."""
    decoded = encode.huffman_decode(*_encoded(spark, d), "doc")
    terms = topk.dual_lists(load_dt(spark, d)).select("doc", F.posexplode("terms").alias("pos", "term"))
    return decoded.join(terms, ["doc", "pos"]).select("doc", "term", F.col("value").alias("freq"))


@_query("huffman_bytes", _recursive(*_huffman("freq"), "SELECT doc, count(*) * 2 AS raw_bytes, CAST(sum(length) // 8 + 1 AS BIGINT) AS encoded_bytes FROM dt JOIN code ON freq = symbol GROUP BY doc"))
def huffman_bytes(spark, d):
    return encode.huffman_bytes(_encoded(spark, d)[0], "doc")


@_query("sum_over_huffman", _SQL["sum_over_runs"])
def sum_over_huffman(spark, d):
    return encode.sum_over_huffman(*_encoded(spark, d))


def _stored_bitmaps(spark, d) -> str:
    path = new_folder(spark, "bitmaps")
    bitmaps.save(division.posting_bitmaps(load_dt(spark, d)), path)
    return path


@_query("stored_bitmap_context", _with(DT, CTX, "SELECT doc FROM ctx"))
def stored_bitmap_context(spark, d):
    """Documents of a context from saved bitmaps: two keys are read, ANDed and turned to rows."""
    ctx = list(parameters(d)["context"])
    return bitmaps.positions(bitmaps.all_of(bitmaps.load(spark, _stored_bitmaps(spark, d), ctx), ctx)).select(F.col("position").alias("doc"))


@_query("bitmap_position_sums", _with(DT, "SELECT term, CAST(sum(doc) AS BIGINT) AS total FROM dt GROUP BY term"))
def bitmap_position_sums(spark, d):
    return bitmaps.position_sums(bitmaps.load(spark, _stored_bitmaps(spark, d))).select(F.col("key").alias("term"), "total")


@_query(
    "bitmap_algebra",
    _with(
        DT, A, B,
        "u AS (SELECT DISTINCT doc FROM dt)",
        "SELECT 'and' AS operation, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'or', count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)"
        " UNION ALL SELECT 'xor', count(*) FROM ((SELECT * FROM a UNION SELECT * FROM b) EXCEPT (SELECT * FROM a INTERSECT SELECT * FROM b))"
        " UNION ALL SELECT 'andnot', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'not', count(*) FROM (SELECT * FROM u EXCEPT SELECT * FROM a)",
    ),
)
def bitmap_algebra(spark, d):
    """Set bits after each word-wise operation on the bitmaps of two document sets."""
    a, b, every = (bitmaps.from_rows(x.select("doc", F.lit(0).cast("long").alias("k")), "k", "doc") for x in _sets(spark, d))
    done = {name: bitmaps.combine(a, b, name) for name in ("and", "or", "xor", "andnot")} | {"not": bitmaps.complement(a, every)}
    counted = [bits.agg(F.coalesce(F.sum(F.expr("bitmap_count(bits)")), F.lit(0)).alias("n")).select(F.lit(name).alias("operation"), "n") for name, bits in done.items()]
    out = counted[0]
    for x in counted[1:]:
        out = out.unionByName(x)
    return out


@_query("fragment_check", _with(DT, "SELECT term AS key, doc AS position, 'list' AS missing_in FROM dt WHERE false"))
def fragment_check(spark, d):
    """Members in which each term's list and bitmap of documents differ: none."""
    dt = load_dt(spark, d)
    return bitmaps.differences(generators.fragments(dt, "term", "doc"), "term", division.posting_bitmaps(dt))


@_query("directory_docs_in_context", _with(DT, CTX, "SELECT doc FROM ctx"))
def directory_docs_in_context(spark, d):
    return layout.docs_in_context(layout.ColumnStore.write(load_dt(spark, d), "term"), list(parameters(d)["context"]))


@_query("directory_cooccurrence", _with(DT, "SELECT b.doc, count(*) AS score, CAST(sum(b.freq) AS BIGINT) AS tf FROM dt a JOIN dt b ON a.term = b.term WHERE a.doc = $seed GROUP BY b.doc"))
def directory_cooccurrence(spark, d):
    dt = load_dt(spark, d)
    return layout.cooccurrence(layout.ColumnStore.write(dt, "doc"), layout.ColumnStore.write(dt, "term"), parameters(d)["seed"])


@_query("author_reach_bucketed", _SQL["author_reach"])
def author_reach_bucketed(spark, d):
    """author_reach over bucketed copies, whose sides of each join lie dealt by its key."""
    kept = layout.bucketed(load_dt(spark, d), load_da(spark, d))
    return paths.author_reach(kept.dt_doc, kept.da_doc, parameters(d)["author"], kept.dt_term)


@_query("topk_dense_in_context", _with(DT, CTX, f"SELECT p_partkey AS term, count(dt.doc) AS score FROM part LEFT JOIN (SELECT * FROM dt WHERE doc IN (SELECT doc FROM ctx)) dt ON p_partkey = dt.term GROUP BY p_partkey ORDER BY score DESC, term LIMIT {K}"))
def topk_dense_in_context(spark, d):
    return topk.top_k(dense_term_counts(spark, d), "term", "score", K)


@_query("docs_with_year", _with(DT, DY, CTX, "SELECT doc, year FROM ctx JOIN dy USING (doc)"))
def docs_with_year(spark, d):
    return division.docs_with_year(load_dt(spark, d), load_dy(spark, d), parameters(d)["context"])


@_query("docs_in_context_by_year", _with(DT, DY, CTX, "SELECT year, count(*) AS n FROM ctx JOIN dy USING (doc) GROUP BY year"))
def docs_in_context_by_year(spark, d):
    return division.docs_in_context_by_year(load_dt(spark, d), load_dy(spark, d), parameters(d)["context"])


@_query(
    "relation_stats",
    _with(DT, DA, "SELECT 'dt_tuples' AS stat, count(*) AS value FROM dt UNION ALL SELECT 'docs', count(DISTINCT doc) FROM dt UNION ALL SELECT 'terms', count(DISTINCT term) FROM dt UNION ALL SELECT 'total_freq', CAST(sum(freq) AS BIGINT) FROM dt UNION ALL SELECT 'da_tuples', count(*) FROM da UNION ALL SELECT 'authors', count(DISTINCT author) FROM da"),
)
def relation_stats(spark, d):
    return histograms.relation_stats(load_dt(spark, d), load_da(spark, d))


# The SQL of the scale that correctness is recorded at.
SQL = oracles("sf0.01")
