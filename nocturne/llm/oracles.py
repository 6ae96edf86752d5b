"""DuckDB statements for the queries that SQL can express."""

from __future__ import annotations

from . import ledger

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

REPEATED_BYTES = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
blocks AS (SELECT doc_id, k, substr(h, 2000 * k + 1, 2198) AS b FROM (SELECT doc_id, h, unnest(range(0, (length(h) // 2 + 900) // 1000)) AS k FROM d WHERE length(h) >= 200)),
windows AS (SELECT doc_id, 1000 * k + j AS i, hash(substr(b, 2 * j + 1, 200)) AS w FROM (SELECT doc_id, k, b, unnest(range(0, length(b) // 2 - 99)) AS j FROM blocks)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS nth FROM windows) WHERE nth > 1),
runs AS (SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (
    SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS opens FROM later)),
spans AS (SELECT doc_id, run, min(i) AS s, max(i) + 100 AS e FROM runs GROUP BY ALL),
gaps AS (SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS a, s AS z FROM spans
    UNION ALL SELECT doc_id, max(e), NULL FROM spans GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (coalesce(z, length(h) // 2) - a)), '' ORDER BY a) AS k FROM gaps JOIN d USING (doc_id) GROUP BY doc_id),
gone AS (SELECT doc_id, CAST(sum(e - s) AS BIGINT) AS n, count(*) AS spans FROM spans GROUP BY doc_id)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN gone USING (doc_id)"""

LEAKS = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
q AS (SELECT row_number() OVER () AS item, item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM (SELECT DISTINCT item_id, text FROM benchmark)),
ks AS (SELECT DISTINCT least(5, len(ws)) AS k FROM q WHERE len(ws) > 0),
ds AS (SELECT DISTINCT doc_id, k, array_to_string(ws[i:i + k - 1], ' ') AS s FROM (SELECT doc_id, k, ws, unnest(range(1, len(ws) - k + 2)) AS i FROM d JOIN ks ON len(ws) >= k)),
qs AS (SELECT DISTINCT item, k, array_to_string(ws[i:i + k - 1], ' ') AS s FROM (SELECT item, least(5, len(ws)) AS k, ws, unnest(range(1, len(ws) - least(5, len(ws)) + 2)) AS i FROM q WHERE len(ws) > 0)),
sizes AS (SELECT item, count(*) AS n_shingles FROM qs GROUP BY item)
SELECT doc_id, item_id, n_shingles, n_shared FROM (SELECT doc_id, item, n_shingles, count(*) AS n_shared FROM qs JOIN ds USING (s, k) JOIN sizes USING (item) GROUP BY ALL HAVING count(*) >= 0.8 * n_shingles) JOIN q USING (item)"""

RECORDS = """
SELECT page_id, bytes AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM (SELECT page_id, bytes, digest, CASE WHEN bytes >= 100 THEN min(page_id) OVER (PARTITION BY digest) ELSE page_id END AS first
      FROM (SELECT page_id, strlen(coalesce(html, '')) AS bytes, sha256(coalesce(html, '')) AS digest FROM pages))"""

REPEATED_WORDS = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM d),
windows AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 19], ' ')) AS w FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM d)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS nth FROM windows) WHERE nth > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM later),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS k FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

NEGATIVES = """
WITH e AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
      FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER best AS INT) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW best AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER best <= 10"""

#: crc32 of the decimal id by its eight steps a byte, as DuckDB has no such function.
TRIE = r"""
WITH RECURSIVE ids AS (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS d FROM conversations WHERE conv_id IS NOT NULL),
crc AS (
    SELECT conv_id, d, 1 AS k, 4294967295::BIGINT AS c FROM ids
    UNION ALL
    SELECT conv_id, d, k + 1, list_reduce(list_prepend(xor(c, ascii(d[k])::BIGINT), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)
    FROM crc WHERE k <= length(d)),
h AS (SELECT conv_id, xor(c, 4294967295::BIGINT) % 4 AS h FROM crc WHERE k = length(d) + 1),
o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, '')) AS pos
      FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT conv_id, count(*) AS n FROM o GROUP BY 1),
c AS (SELECT h.conv_id, h, least(h, coalesce(b.n, 0)) AS take FROM h LEFT JOIN n b ON b.conv_id = h.conv_id - h.conv_id % 20),
r AS (SELECT c.conv_id, pos, role, text FROM c JOIN o ON o.conv_id = c.conv_id - c.conv_id % 20 AND pos <= take
      UNION ALL SELECT c.conv_id, pos - h + take, role, text FROM c JOIN o USING (conv_id) WHERE pos > h),
pre AS (SELECT conv_id, pos AS depth, text, sha256(string_agg(length(role) || ':' || length(text) || ':' || role || text, '') OVER (PARTITION BY conv_id ORDER BY pos)) AS path FROM r
        UNION ALL SELECT conv_id, 0, '', 'root' FROM ids),
m AS (SELECT conv_id, depth, text, min(conv_id) OVER (PARTITION BY depth, path) AS rep, depth = max(depth) OVER (PARTITION BY conv_id) AS ended FROM pre),
nodes AS (SELECT rep, depth, count(*) AS n_convs, (count(*) - 1) * CASE WHEN depth = 0 THEN 0 ELSE len(regexp_extract_all(any_value(text), '[^\x20\x09-\x0D]+')) END AS saved,
                 sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ended), '')) AS ends_sha256 FROM m GROUP BY 1, 2),
up AS (SELECT a.rep, a.depth, b.rep AS parent FROM nodes a LEFT JOIN m b ON b.conv_id = a.rep AND b.depth = a.depth - 1),
kids AS (SELECT parent AS rep, depth - 1 AS depth, count(*) AS n FROM up WHERE depth > 0 GROUP BY 1, 2),
whole AS (SELECT m.rep, m.depth, sum(y.saved) AS saved, sum(CASE WHEN k.n IS NULL THEN 1 ELSE 0 END) AS leaves
          FROM nodes y JOIN m ON m.conv_id = y.rep AND m.depth <= y.depth LEFT JOIN kids k ON k.rep = y.rep AND k.depth = y.depth GROUP BY 1, 2)
SELECT rep AS conv_id, depth, parent AS parent_conv_id, n_convs, coalesce(n, 0) AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(whole.saved AS BIGINT) AS saved_tokens, ends_sha256
FROM nodes JOIN up USING (rep, depth) JOIN whole USING (rep, depth) LEFT JOIN kids USING (rep, depth)"""


def _found(rule: ledger.Rule, rank: int) -> str:
    """Spans of one rule: the text is split at the matches and lengths are added up."""
    pattern = rule.pattern.replace("'", "''")
    return f"""SELECT row, '{rule.kind}' AS kind, {rank} AS rank, list_sum(list_transform(pieces[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS s, length(ms[i]) AS n, length(gs[i]) AS g
    FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (
        SELECT row, string_split_regex(t, '{pattern}') AS pieces, regexp_extract_all(t, '{pattern}', 0) AS ms, regexp_extract_all(t, '{pattern}', {rule.group}) AS gs FROM d))
    WHERE length(gs[i]) >= {rule.least}"""


SECRETS = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({" UNION ALL ".join(_found(rule, i) for i, rule in enumerate(ledger.RULES))}),
listed AS (SELECT row, kind, rank, CAST(s AS BIGINT) AS s, kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + n AS BIGINT) AS span FROM spans),
byrow AS (SELECT row, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
                 string_agg(span, ',' ORDER BY s, rank) FILTER (rank < {len(ledger.BASE)}) AS base, string_agg(span, ',' ORDER BY s, rank) AS spans FROM listed GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN byrow USING (row)"""

ORACLES = {
    "op2_suffix_array_dedup": REPEATED_BYTES,
    "op5_benchmark_decontamination": LEAKS,
    "op7_warc": RECORDS,
    "op10_substring_dedup": REPEATED_WORDS,
    "op11_hard_negatives": NEGATIVES,
    "op12_prefix_trie": TRIE,
    "op13_secret_scan": SECRETS,
}
