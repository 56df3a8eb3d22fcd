"""DuckDB SQL for the training-data queries that SQL can express."""
from __future__ import annotations

WORDS = r"[^\x20\x09-\x0D]+"

OP3 = rf"""
WITH sized AS (
  SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '{WORDS}'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS order_key, md5(coalesce(text, '')) AS text_key
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, 2 * sum(size)::BIGINT AS cap,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS source_rank
  FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE source_rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
         sum(source_size) OVER () * 1.5::DOUBLE AS budget FROM sources),
levels AS (
  SELECT *, (budget - coalesce(sum(cap) OVER held_before, 0)) /
            (sum(weight) OVER () - coalesce(sum(weight) OVER held_before, 0))::DOUBLE AS level,
         cap::DOUBLE / weight AS ratio
  FROM weighed
  WINDOW held_before AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT *, CASE WHEN ratio <= level THEN cap::DOUBLE
                 ELSE weight * first_value(level) OVER (ORDER BY ratio <= level, ratio, source NULLS LAST) END AS target
  FROM levels),
queue AS (
  SELECT d.*, t.source_rank, t.source_size, t.target, t.budget,
         sum(d.size) OVER (PARTITION BY t.source_rank ORDER BY d.order_key, d.size, d.text_key
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cumulative,
         row_number() OVER () AS rid
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
copies AS (
  SELECT rid, size, source_rank, budget, (cumulative + source_size * k)::DOUBLE / target AS finish
  FROM queue, (VALUES (0), (1)) v(k) WHERE size > 0),
ordered AS (
  SELECT *, sum(size) OVER (ORDER BY finish, source_rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM copies),
got AS (SELECT rid, count(*) AS copies FROM ordered WHERE upto <= budget GROUP BY rid)
SELECT doc_id, size, source_size, target, (size * coalesce(copies, 0))::BIGINT AS taken,
       coalesce(copies, 0)::INTEGER AS copies
FROM queue LEFT JOIN got USING (rid)
"""

OP4 = """
WITH records AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY html ORDER BY page_id DESC NULLS LAST) AS place,
         max(page_id) OVER (PARTITION BY html) AS top
  FROM records)
SELECT page_id, payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN payload_bytes >= 1000 AND place > 1 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND place > 1 THEN top END AS refers_to
FROM ranked
"""

OP12 = r"""
WITH rests AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest,
         row_number() OVER () AS rid
  FROM pages),
parsed AS (
  SELECT rid, page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rests),
rules(rule_host, rule_path, rule_verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
         ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
fitting AS (
  SELECT *, row_number() OVER (PARTITION BY rid ORDER BY length(rule_host || rule_path) DESC NULLS LAST, length(rule_host) DESC NULLS LAST) AS place
  FROM parsed LEFT JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule_host || rule_path AS rule, coalesce(rule_verdict, 'allow') AS verdict
FROM fitting WHERE place = 1
"""

ORACLES: dict[str, str] = {"op3_weighted_fair_mix": OP3, "op4_warc_archive": OP4, "op12_url_rules": OP12}
