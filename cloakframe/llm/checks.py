"""SQL that the n-gram join, the ranked search and the manifest are checked with."""

from __future__ import annotations

LOWERED = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Heights that the SQL below is written out for: trees of up to 8**7 leaves, and up to 64 trees.
_HEIGHTS, _TOP = 7, 2


def _leaf(text: str) -> str:
    fields = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields) + ")"


def _manifest() -> str:
    low = LOWERED.format("text")
    parts = [f"""
WITH crc AS (
  SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS t),
d AS (
  SELECT *, {_leaf("text")} AS leaf, {_leaf(low)} AS lowered,
    xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
      lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]), 4294967295::BIGINT), 4294967295) % 3 = 0 AS tampered
  FROM documents, crc),
l AS (
  SELECT doc_id, leaf, CASE WHEN tampered THEN lowered ELSE leaf END AS folded_0,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
    count(*) OVER (PARTITION BY lang) AS n, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS t
  FROM d),
a0 AS (SELECT t, i, leaf AS d, n FROM l)"""]
    level = """
{0}{2} AS (
  SELECT t, i // 8 AS i, CASE WHEN n > 1 THEN sha256(string_agg(d, '' ORDER BY i)) ELSE min(d) END AS d,
    (n + 7) // 8 AS n, list(d ORDER BY i) AS c, n > 1 AS up
  FROM {0}{1} GROUP BY t, i // 8, n)"""
    parts += [level.format("a", k, k + 1) for k in range(_HEIGHTS)]
    parts.append(f"\nb0 AS (SELECT 0 AS t, t AS i, d, count(*) OVER () AS n FROM a{_HEIGHTS})")
    parts += [level.format("b", k, k + 1) for k in range(_TOP)]
    parts.append(f"""
p0 AS (
  SELECT l.doc_id, leaf, l.t, l.i, folded_0 AS folded, '' AS beside, s.d AS subroot, r.d AS root
  FROM l JOIN a{_HEIGHTS} s ON s.t = l.t CROSS JOIN b{_TOP} r)""")
    steps = [("a", k, "p.t", "p.i") for k in range(_HEIGHTS)] + [("b", k, "0", "p.t") for k in range(_TOP)]
    for at, (name, k, tree, rank) in enumerate(steps):
        left = f"coalesce(array_to_string(x.c[1:({rank} // {8**k}) % 8], ''), '')"
        right = f"coalesce(array_to_string(x.c[({rank} // {8**k}) % 8 + 2:], ''), '')"
        parts.append(f"""
p{at + 1} AS (
  SELECT doc_id, leaf, p.t, p.i, subroot, root,
    CASE WHEN x.up THEN sha256({left} || folded || {right}) ELSE folded END AS folded,
    CASE WHEN x.up THEN beside || {left} || {right} ELSE beside END AS beside
  FROM p{at} p JOIN {name}{k + 1} x ON x.t = {tree} AND x.i = {rank} // {8 ** (k + 1)})""")
    return ",".join(parts) + f"""
SELECT doc_id, leaf, subroot, root, sha256(beside) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM p{len(steps)}
"""


MANIFEST = _manifest()

TERMS = r"regexp_extract_all(" + LOWERED.format("coalesce({0}, '')") + r", '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

RANKED = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {TERMS.format("text")} AS w FROM documents),
q AS (SELECT row_number() OVER () AS q, item_id, {TERMS.format("text")} AS w FROM benchmark),
size AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_all FROM d WHERE len(w) > 0),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY r, term),
weight AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), size),
asked AS (SELECT q, item_id, term, count(*) AS times FROM (SELECT q, item_id, unnest(w) AS term FROM q) GROUP BY ALL),
impact AS (
  SELECT d.r, doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * len(d.w) * n_docs) // n_all)) AS impact
  FROM tf JOIN d USING (r), size),
score AS (
  SELECT q, item_id, r, doc_id, CAST(sum(times * w * impact) AS BIGINT) AS score
  FROM asked JOIN weight USING (term) JOIN impact USING (term) GROUP BY ALL)
SELECT item_id, CAST(n AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS FIRST) AS n FROM score WHERE score > 0)
WHERE n <= 10
"""

SHINGLES = r"regexp_extract_all(" + LOWERED.format("coalesce({0}, '')") + r", '[^\x20\x09-\x0D]+')"

NGRAM_JOIN = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {SHINGLES.format("text")} AS w FROM documents),
g AS (
  SELECT r, doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda s: array_to_string(w[s:s + 3], ' ')) END)) AS g
  FROM d),
s AS (SELECT row_number() OVER () AS s, g FROM (SELECT DISTINCT g FROM g WHERE len(g) > 0)),
one AS (SELECT s, len(g) AS n, unnest(g) AS gram FROM s),
pair AS (
  SELECT a.s AS u, b.s AS v
  FROM one a JOIN one b ON a.gram = b.gram AND a.s <> b.s AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n
  GROUP BY a.s, b.s, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT s AS u, s AS v FROM s UNION SELECT reach.u, pair.v FROM reach JOIN pair ON reach.v = pair.u),
named AS (SELECT s, min(doc_id) AS first FROM s JOIN g USING (g) GROUP BY s),
least AS (SELECT u AS s, min(first) AS component_id FROM reach JOIN named ON v = s GROUP BY u)
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, CASE WHEN len(g) = 0 THEN doc_id ELSE component_id END AS component_id
FROM g LEFT JOIN s USING (g) LEFT JOIN least USING (s)
"""
