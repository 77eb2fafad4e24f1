"""SQL that queries of this subpackage must agree with, for an engine with lists, lambdas, sha256 and recursive queries."""

from __future__ import annotations

CRC_TABLE = """crc_table AS (
  SELECT list(v ORDER BY k) AS t FROM (
    SELECT k, list_reduce([k::BIGINT] || range(8), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) AS r(k)))"""


def crc32(codes: str) -> str:
    """Unsigned crc32 of a list of bytes; ``t`` of ``crc_table`` must be in scope."""
    return f"xor(list_reduce([4294967295::BIGINT] || {codes}, lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295)"


def utf8(text: str) -> str:
    """Bytes of a text without code points over U+07FF."""
    one = "CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [192 | (ord(c)::BIGINT >> 6), 128 | (ord(c)::BIGINT & 63)] END"
    return f"flatten(list_transform(string_split({text}, ''), lambda c: {one}))"


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: str) -> str:
    return f"translate({text}, '{UPPER}', '{LOWER}')"


def _row_digest(text: str) -> str:
    one = [f"coalesce(strlen({v}::VARCHAR) || ':' || {v}::VARCHAR, '-')" for v in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(one)})"


MANIFEST = f"""
WITH RECURSIVE {CRC_TABLE},
leaves AS (
  SELECT doc_id, coalesce('=' || source, '-') AS tree, {_row_digest('text')} AS leaf,
    CASE WHEN {crc32(utf8('doc_id::VARCHAR'))} % 5 = 0 THEN {_row_digest(lowered('text'))} ELSE {_row_digest('text')} END AS now
  FROM documents, crc_table),
ranked AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
nodes AS (
  SELECT tree, n, 0 AS level, rank AS j, leaf AS h FROM ranked
  UNION ALL
  SELECT tree, n, level + 1, j // 16, sha256(string_agg(h, '' ORDER BY j)) FROM nodes WHERE n > (1::BIGINT << (4 * level)) GROUP BY tree, n, level, j // 16),
own AS MATERIALIZED (SELECT * FROM nodes),
tops AS MATERIALIZED (
  SELECT tree, h, row_number() OVER (ORDER BY encode(tree)) - 1 AS rank, count(*) OVER () AS n FROM own
  WHERE n <= (1::BIGINT << (4 * level))),
high AS (
  SELECT n, 0 AS level, rank AS j, h FROM tops
  UNION ALL
  SELECT n, level + 1, j // 16, sha256(string_agg(h, '' ORDER BY j)) FROM high WHERE n > (1::BIGINT << (4 * level)) GROUP BY n, level, j // 16),
upper AS MATERIALIZED (SELECT * FROM high),
beside AS MATERIALIZED (
  SELECT a.tree, a.level, a.j, coalesce(string_agg(b.h, '' ORDER BY b.j) FILTER (b.j < a.j), '') AS lft, coalesce(string_agg(b.h, '' ORDER BY b.j) FILTER (b.j > a.j), '') AS rgt
  FROM own a JOIN own b ON a.tree = b.tree AND a.level = b.level AND a.j // 16 = b.j // 16
  WHERE a.n > (1::BIGINT << (4 * a.level)) GROUP BY a.tree, a.level, a.j
  UNION ALL
  SELECT '', a.level, a.j, coalesce(string_agg(b.h, '' ORDER BY b.j) FILTER (b.j < a.j), ''), coalesce(string_agg(b.h, '' ORDER BY b.j) FILTER (b.j > a.j), '')
  FROM upper a JOIN upper b ON a.level = b.level AND a.j // 16 = b.j // 16
  WHERE a.n > (1::BIGINT << (4 * a.level)) GROUP BY a.level, a.j),
ways AS MATERIALIZED (
  SELECT r.tree, r.rank, s.lft, s.rgt, row_number() OVER (PARTITION BY r.tree, r.rank ORDER BY s.tree = '', s.level) AS k
  FROM ranked r JOIN tops t ON r.tree = t.tree
  JOIN beside s ON (s.tree = r.tree AND s.j = r.rank // (1::BIGINT << (4 * s.level))) OR (s.tree = '' AND s.j = t.rank // (1::BIGINT << (4 * s.level)))),
fold AS (
  SELECT tree, rank, 0 AS k, now AS h FROM ranked
  UNION ALL
  SELECT f.tree, f.rank, f.k + 1, sha256(w.lft || f.h || w.rgt) FROM fold f JOIN ways w ON f.tree = w.tree AND f.rank = w.rank AND w.k = f.k + 1),
proofs AS (SELECT tree, rank, sha256(string_agg(lft || rgt, '' ORDER BY k)) AS proof FROM ways GROUP BY tree, rank),
root AS (SELECT h FROM upper WHERE n <= (1::BIGINT << (4 * level)))
SELECT r.doc_id, r.leaf, t.h AS subroot, root.h AS root, coalesce(p.proof, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = root.h AS verified
FROM ranked r JOIN tops t ON r.tree = t.tree CROSS JOIN root
LEFT JOIN proofs p ON r.tree = p.tree AND r.rank = p.rank
JOIN (SELECT tree, rank, arg_max(h, k) AS h FROM fold GROUP BY tree, rank) f ON r.tree = f.tree AND r.rank = f.rank
"""

NGRAM_JOIN = f"""
WITH RECURSIVE texts AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all({lowered("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
grams AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS gram
  FROM texts, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS r(i)),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS same FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS MATERIALIZED (
  SELECT s.a, s.b FROM shared s JOIN sizes x ON s.a = x.doc_id JOIN sizes y ON s.b = y.doc_id
  WHERE 100 * s.same >= 80 * (x.n + y.n - s.same)),
ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS node, doc_id AS low FROM texts
  UNION
  SELECT w.b, r.low FROM reach r JOIN ways w ON r.node = w.a WHERE r.low < w.b)
SELECT t.doc_id, coalesce(s.n, 0) AS n_shingles, min(r.low) AS component_id
FROM texts t LEFT JOIN sizes s ON t.doc_id = s.doc_id JOIN reach r ON r.node = t.doc_id GROUP BY t.doc_id, s.n
"""

SPELLING = f"""
WITH RECURSIVE {CRC_TABLE},
runs AS MATERIALIZED (
  SELECT doc_id, run, count(*) AS k FROM (
    SELECT doc_id, {lowered("unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{00C0}-\\x{00FF}]+'))")} AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY doc_id, run),
hashed AS MATERIALIZED (SELECT run, k, {crc32(utf8("coalesce(doc_id::VARCHAR, '') || ':' || run"))} AS h FROM runs, crc_table),
damaged AS (
  SELECT CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, k FROM hashed),
words AS MATERIALIZED (SELECT word, sum(k)::BIGINT AS n FROM damaged WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
without AS MATERIALIZED (
  SELECT DISTINCT word, n, left(word, i::INT) || substr(word, i::INT + 2) AS rest, left(word, i::INT) || '*' || substr(word, i::INT + 2) AS open
  FROM words, unnest(range(length(word))) AS r(i)),
near AS MATERIALIZED (
  SELECT a.word, b.word AS near, b.n AS near_n FROM without a JOIN without b ON a.open = b.open AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM without a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM without a JOIN words b ON a.rest = b.word),
best AS (
  SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, encode(near)) AS near, max(near_n) AS near_n FROM near GROUP BY word),
named AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.near_n >= 10 * w.n THEN b.near END AS form, CASE WHEN b.near_n >= 10 * w.n THEN b.near_n END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word),
way AS (
  SELECT word, word AS here, 0 AS k FROM named
  UNION ALL
  SELECT y.word, f.form, y.k + 1 FROM way y JOIN named f ON y.here = f.word WHERE f.form IS NOT NULL)
SELECT d.word, d.form, y.root, d.n, d.n_near, d.form_n FROM named d JOIN (SELECT word, arg_max(here, k) AS root FROM way GROUP BY word) y ON d.word = y.word
"""
