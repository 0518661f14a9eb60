"""DuckDB SQL for the queries of this subpackage that SQL can express.

Written from what each query returns, not from how its operator finds it: windows and seeds
are compared as words, not as hashes.
"""

from __future__ import annotations

from tessera.llm.decontaminate import AFTER, LEAST, LEAST_ITEM, MASKS, REACH, RUN, SHARE
from tessera.llm.substrings import WINDOW
from tessera.llm.warc import LEAST_REVISIT

_REPEATS = rf"""
WITH word AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents)
), run AS (
  SELECT *, string_agg(word, ' ') OVER ahead AS run, count(*) OVER ahead AS size FROM word
  WINDOW ahead AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING)
), least AS (
  SELECT run, min(doc_id) AS least FROM run WHERE size = {WINDOW} GROUP BY run HAVING min(doc_id) < max(doc_id)
), marked AS (
  SELECT doc_id, i, word, size = {WINDOW} AND coalesce(doc_id > least, false) AS repeats FROM run LEFT JOIN least USING (run)
), judged AS (
  SELECT doc_id, i, word, bool_or(repeats) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS gone FROM marked
)
SELECT doc_id, count(word) AS n_words, count(*) FILTER (gone) AS n_removed,
  sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM documents LEFT JOIN judged USING (doc_id) GROUP BY doc_id
"""

_PAGES = f"""
WITH payload AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), judged AS (
  SELECT *, CASE WHEN payload_bytes >= {LEAST_REVISIT} THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS least FROM payload
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > least THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > least THEN least END AS refers_to
FROM judged
"""


def _overlaps() -> str:
    span = max(m[-1] for m in MASKS) + 1

    def tokens(table: str, key: str) -> str:
        return f"""
  SELECT {key}, n, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS spot FROM (
    SELECT {key}, w, len(w) AS n FROM (
      SELECT {key}, string_split(clean, ' ') AS w FROM (
        SELECT {key}, trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS clean FROM {table}) WHERE clean <> ''))"""

    def seeds(key: str, source: str) -> str:
        ahead = ", ".join(f"lead(word, {o}) OVER ahead AS t{o}" for o in range(span))
        fixed = [f"SELECT {key}, spot, {k} AS mask, concat_ws(' ', {', '.join(f't{o}' for o in m)}) AS seed FROM {source}_ahead WHERE t{m[-1]} IS NOT NULL" for k, m in enumerate(MASKS)]
        short = [f"SELECT {key}, spot, {100 + n}, concat_ws(' ', {', '.join(f't{o}' for o in range(n))}) FROM {source}_ahead WHERE t{n - 1} IS NOT NULL AND {n} IN (SELECT n FROM item)" for n in range(LEAST_ITEM, span) if n != len(MASKS[0])]
        return f"{source}_ahead AS (SELECT {key}, spot, {ahead} FROM {source} WINDOW ahead AS (PARTITION BY {key} ORDER BY spot)), {source}_seed AS ({' UNION ALL '.join(fixed + short)})"

    def agree(rows: str, keys: str, start: str, lo: str, hi: str) -> str:
        """For rows of alignments: how many of the aligned tokens from lo to hi agree."""
        return f"""
  SELECT {keys}, count(*) AS length, count(*) FILTER (d.word = i.word) AS matched
  FROM (SELECT *, unnest(range({lo}, {hi} + 1)) AS j FROM {rows}) AS x
  JOIN doc AS d ON d.doc_id = x.doc_id AND d.spot = {start} + x.j JOIN item AS i ON i.item_id = x.item_id AND i.spot = x.j
  GROUP BY {keys}"""

    return f"""
WITH doc AS ({tokens('documents', 'doc_id')}), item AS (SELECT * FROM ({tokens('benchmark', 'item_id')}) WHERE n >= {LEAST_ITEM}),
{seeds('doc_id', 'doc')}, {seeds('item_id', 'item')},
size AS (SELECT DISTINCT doc_id, n AS doc_n FROM doc), item_size AS (SELECT DISTINCT item_id, n AS item_n FROM item),
hit AS (
  SELECT DISTINCT doc_id, item_id, d.spot AS pos, i.spot AS q, doc_n, item_n
  FROM doc_seed AS d JOIN item_seed AS i USING (mask, seed) JOIN size USING (doc_id) JOIN item_size USING (item_id)
), near AS ({agree('hit', 'x.doc_id, x.item_id, x.pos, x.q, x.doc_n, x.item_n', '(x.pos - x.q)', f'greatest(q - {REACH}, 0, q - pos)', f'least(q + {AFTER}, item_n - 1, q + doc_n - 1 - pos)')}),
aligned AS (
  SELECT x.doc_id, x.item_id, x.pos, x.q, doc_n, item_n, x.j, d.word = i.word AS same
  FROM (SELECT *, unnest(range(greatest(q - {RUN - 1}, 0, q - pos), least(q + {RUN - 1}, item_n - 1, q + doc_n - 1 - pos) + 1)) AS j FROM hit) AS x
  JOIN doc AS d ON d.doc_id = x.doc_id AND d.spot = x.pos - x.q + x.j JOIN item AS i ON i.item_id = x.item_id AND i.spot = x.j
), within AS (
  SELECT doc_id, item_id, pos, q, doc_n, item_n, count(*) OVER ahead AS length, count(*) FILTER (same) OVER ahead AS matched FROM aligned
  WINDOW ahead AS (PARTITION BY doc_id, item_id, pos, q ORDER BY j ROWS BETWEEN CURRENT ROW AND {RUN - 1} FOLLOWING)
),
judged AS (
  SELECT DISTINCT doc_id, item_id, pos - q AS start, doc_n, item_n FROM near
  WHERE matched >= greatest({LEAST_ITEM}, least({LEAST}, item_n)) AND matched >= {SHARE} * length AND length >= least({LEAST + 3}, item_n)
  UNION
  SELECT DISTINCT doc_id, item_id, pos - q, doc_n, item_n FROM within WHERE length = {RUN} AND matched >= {SHARE * RUN}
), measured AS ({agree('judged', 'x.doc_id, x.item_id, x.start', 'x.start', 'greatest(0, -start)', 'least(item_n, doc_n - start) - 1')}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matched DESC, start, length DESC) AS place FROM measured)
SELECT doc_id, item_id, CAST(start AS INTEGER) AS start, CAST(length AS INTEGER) AS length, CAST(matched AS INTEGER) AS matched, matched / length AS share
FROM ranked WHERE place = 1
"""


# The rest is beyond SQL: vocabularies and tokenizers (1, 3, 10), learned models (2, 4), XXH64 (6), sketches (7).
SQL = {"op5_decontamination": _overlaps(), "op8_warc": _PAGES, "op9_substrings": _REPEATS}
