"""DuckDB SQL for the queries that SQL can express.

The others hash with XXH64, train, draw keyed surrogates, replay merges, count guesses or approximate; their tests compare them with
brute-force versions instead.
"""

from llm.license_join import NOTICES, PHRASES, templates

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: crc32 of a decimal number, bit by bit.
_CRC32 = """
xor(4294967295, list_reduce(
  flatten(list_transform(range(1, length(CAST(c AS VARCHAR)) + 1), lambda i: [ascii(substr(CAST(c AS VARCHAR), CAST(i AS INTEGER), 1)), 0, 0, 0, 0, 0, 0, 0])),
  lambda s, b: xor(xor(s, b) >> 1, CASE WHEN xor(s, b) & 1 = 1 THEN 3988292384 ELSE 0 END), 4294967295))"""

_TEMPLATES = ", ".join(
    f"({number}, '{t.label}', {t.phrase}, {t.step}, {t.need}, {list(t.words)})" for number, t in enumerate(templates(PHRASES, NOTICES, 0.8))
)

ORACLE: dict[str, str] = {
    "op8_warc_revisits": """
WITH heads AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS bytes, sha256(coalesce(html, '')) AS digest FROM pages),
firsts AS (SELECT digest, min(page_id) AS first FROM heads WHERE bytes >= 100 GROUP BY digest)
SELECT page_id, bytes AS payload_bytes, digest AS payload_digest,
       CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM heads LEFT JOIN firsts USING (digest)""",
    # The pages hold no canonical link or refresh, so no page has aliases.
    "op10_url_verdicts": f"""
WITH rules(site, start, own) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'),
         ('com', '/de/', 'block')),
parts AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}'), '') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
sites AS (SELECT DISTINCT host, path FROM parts),
best AS (
  SELECT host, path, max_by(site || start, length(site || start)) AS rule, max_by(own, length(site || start)) AS own
  FROM sites JOIN rules ON (host = site OR ends_with(host, '.' || site)) AND starts_with(path, start) GROUP BY host, path)
SELECT page_id, host, path, rule, coalesce(own, 'allow') AS verdict, CAST(NULL AS VARCHAR) AS alias_root
FROM parts LEFT JOIN best USING (host, path)""",
    "op12_conversation_trie": f"""
WITH own AS (
  SELECT conv_id AS c, md5(coalesce(role, '')) || md5(coalesce(text, '')) AS said, length(coalesce(text, '')) AS chars,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, {_CRC32} % 6 AS h FROM (SELECT DISTINCT c FROM own)),
rebuilt AS (
  SELECT convs.c, 0 AS own, i, said, chars FROM convs JOIN own ON own.c = convs.c - convs.c % 100 AND i <= h
  UNION ALL SELECT c, 1, i, said, chars FROM convs JOIN own USING (c) WHERE i > h),
lists AS (
  SELECT convs.c, coalesce(list(said ORDER BY own, i) FILTER (WHERE said IS NOT NULL), []) AS said,
         coalesce(list(chars ORDER BY own, i) FILTER (WHERE said IS NOT NULL), []) AS chars
  FROM convs LEFT JOIN rebuilt USING (c) GROUP BY convs.c),
steps AS (
  SELECT c, d, length(said) AS turns, md5(array_to_string(said[:d], ',')) AS node,
         CASE WHEN d > 0 THEN md5(array_to_string(said[:d - 1], ',')) END AS parent, CASE WHEN d > 0 THEN chars[d] ELSE 0 END AS chars
  FROM lists, unnest(range(0, length(said) + 1)) AS t(d)),
nodes AS (
  SELECT node, d, any_value(parent) AS parent, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(chars) AS saved,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE turns = d), '')) AS ends_sha256
  FROM steps GROUP BY node, d),
children AS (SELECT parent AS node, d - 1 AS d, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
below AS (
  SELECT DISTINCT up.node, up.d, down.node AS under, down.d AS depth
  FROM steps AS up JOIN steps AS down ON up.c = down.c AND down.d >= up.d),
sums AS (
  SELECT below.node, below.d, count(*) FILTER (WHERE children.node IS NULL) AS n_leaves, sum(nodes.saved) AS saved_tokens
  FROM below JOIN nodes ON nodes.node = under AND nodes.d = depth LEFT JOIN children ON children.node = under AND children.d = depth GROUP BY ALL)
SELECT nodes.conv_id, CAST(nodes.d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, nodes.n_convs, coalesce(n_children, 0) AS n_children, n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, nodes.ends_sha256
FROM nodes JOIN sums ON sums.node = nodes.node AND sums.d = nodes.d LEFT JOIN children ON children.node = nodes.node AND children.d = nodes.d
LEFT JOIN nodes AS up ON up.node = nodes.parent AND up.d = nodes.d - 1""",
    # Every template against every block of its length.
    "op13_license_scan": rf"""
WITH known(template, label, phrase, step, need, words) AS (VALUES {_TEMPLATES}),
docs AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
blocks AS (
  SELECT r, step, w[k * step + 1 : k * step + 2 * step] AS block
  FROM docs, (SELECT DISTINCT step FROM known), unnest(range(0, (length(w) + step - 1) // step)) AS t(k)),
held AS (
  SELECT r, label, length(list_intersect(list_distinct(block), list_distinct(words))) / length(list_distinct(words)) AS share
  FROM blocks JOIN known USING (step)
  WHERE NOT phrase AND length(list_intersect(list_distinct(block), list_distinct(words))) >= need),
places AS (
  SELECT r, label, i - 1 AS place
  FROM docs, known, unnest(range(1, length(w) + 1)) AS t(i)
  WHERE phrase AND w[i] = words[1] AND w[i : i + length(words) - 1] = words),
seen AS (
  SELECT r, label, NULL AS base, NULL AS place, share FROM held
  UNION ALL SELECT r, label, label, place, 1 FROM places),
sums AS (
  SELECT r, count(place) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT base, ',' ORDER BY base) AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
  FROM seen GROUP BY r)
SELECT doc_id, length(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM docs LEFT JOIN sums USING (r)""",
}
