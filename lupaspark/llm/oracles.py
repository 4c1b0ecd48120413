"""SQL beside the queries that SQL can express, for DuckDB over the same tables."""

from __future__ import annotations

SQL: dict[str, str] = {
    "op10_url_filter": r"""
WITH u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), c AS (
  SELECT *, regexp_replace(host, '^(www|m|blog)\.', '') || regexp_replace(regexp_replace(path, '\.html$', ''), '/+$', '') AS url_key FROM u
), l AS (
  SELECT DISTINCT url_key FROM c WHERE len(list_intersect(string_split(host, '.'), ['spam-farm', 'free-bets', 'cheap-pills', 'casino-win', 'adult-x', 'ads-track'])) > 0
), r(rule_host, rule_path, verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), f AS (
  SELECT page_id, max({'chars': strlen(rule_host || rule_path), 'host_chars': strlen(rule_host), 'rule': rule_host || rule_path, 'verdict': verdict}) AS best
  FROM c JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id
)
SELECT page_id, host, path, best.rule AS rule, CASE WHEN best IS NOT NULL THEN best.verdict WHEN l.url_key IS NOT NULL AND host <> '' THEN 'block' ELSE 'allow' END AS verdict, best IS NULL AND l.url_key IS NOT NULL AND host <> '' AS listed
FROM c LEFT JOIN f USING (page_id) LEFT JOIN l USING (url_key)
""",
    "op11_fim": r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tok, sha256('42:' || doc_id) AS h FROM documents
), d AS (
  SELECT *, len(tok) AS n, ('0x' || h[1:8])::BIGINT % (len(tok) + 1) AS h1, ('0x' || h[9:16])::BIGINT % (len(tok) + 1) AS h2,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 50 THEN 'plain' WHEN ('0x' || h[25:32])::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM t
), p AS (
  SELECT *, array_to_string(tok[1:least(h1, h2)], '') AS prefix, array_to_string(tok[least(h1, h2) + 1:greatest(h1, h2)], '') AS middle, array_to_string(tok[greatest(h1, h2) + 1:], '') AS suffix FROM d
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
""",
    "op12_suffix_dedup": r"""
WITH d AS (
  SELECT doc_id, hex(coalesce(text, '')) AS x, strlen(coalesce(text, '')) AS n FROM documents
), c AS (
  SELECT doc_id, n, k, x[2 * k + 1:2 * k + 498] AS part FROM (SELECT doc_id, n, x, unnest(range(0, n - 49, 200)) AS k FROM d)
), w AS (
  SELECT doc_id, k + j AS i, part[2 * j + 1:2 * j + 100] AS s FROM (SELECT doc_id, k, part, unnest(range(0, least(200, n - 49 - k))) AS j FROM c)
), m AS (
  SELECT s, min(doc_id) AS least FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)
), f AS (
  SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM w JOIN m USING (s) WHERE least < doc_id
), r AS (
  SELECT doc_id, min(i) AS start, max(i) + 50 AS stop FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM f) GROUP BY doc_id, run
), k AS (
  SELECT doc_id, start, stop, coalesce(lag(stop) OVER (PARTITION BY doc_id ORDER BY start), 0) AS before FROM r
), a AS (
  SELECT doc_id, sum(stop - start) AS n_removed, count(*) AS n_spans, max(stop) AS last, string_agg(x[2 * before + 1:2 * start], '' ORDER BY start) AS kept FROM k JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(CASE WHEN a.doc_id IS NULL THEN x ELSE kept || x[2 * last + 1:] END)) AS kept_sha256
FROM d LEFT JOIN a USING (doc_id)
""",
    "op13_importance_resampling": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark
), f AS (
  SELECT doc_id, unnest(w) AS word FROM d
), c AS (
  SELECT list(list_reduce([i, 0, 1, 2, 3, 4, 5, 6, 7], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crc FROM range(256) AS r(i)
), k AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, 2 * strlen(word), 2), lambda i: ('0x' || hex(word)[i:i + 1])::BIGINT)), lambda a, x: xor(a >> 8, crc[(xor(a, x) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT word FROM f UNION SELECT word FROM b), c
), s AS (
  SELECT bucket, count(*) AS n FROM f JOIN k USING (word) GROUP BY bucket
), t AS (
  SELECT bucket, count(*) AS n FROM b JOIN k USING (word) GROUP BY bucket
), g AS (
  SELECT bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM f) + 10000)::DOUBLE / ((s.n + 1)::DOUBLE * ((SELECT count(*) FROM b) + 10000)::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)
), x AS (
  SELECT doc_id, sum(gain) AS weight FROM f JOIN k USING (word) JOIN g USING (bucket) GROUP BY doc_id
), y AS (
  SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || doc_id)[1:8])::BIGINT + 0.5) / 4294967296.0)))::BIGINT AS score FROM d LEFT JOIN x USING (doc_id)
), r AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM y WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) * 10 // 100 FROM r) THEN rank END AS rank FROM y LEFT JOIN r USING (doc_id)
""",
}
