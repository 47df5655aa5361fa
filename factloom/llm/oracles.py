"""DuckDB SQL that gives the rows of those queries of this package that SQL can express."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

EXACT_DEDUP = """
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""

JACCARD_COMPONENTS = rf"""
    WITH RECURSIVE words AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    sets AS (
        SELECT DISTINCT doc_id, array_to_string(w[k : k + 3], ' ') AS s
        FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS k FROM words WHERE len(w) > 0)),
    sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
    common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
    links AS (
        SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
    both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a)
    SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id
    FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) ON a = d.doc_id"""


def url_rules(rules: list[tuple[str, str]]) -> str:
    """Links are the absolute canonical and refresh urls of the html, and those relative to the host's root."""
    values = ", ".join(f"('{verdict}', '{rule.partition('/')[0]}', '/{rule.partition('/')[2]}', '{rule}')" for verdict, rule in rules)

    def parts(url: str) -> str:
        rest = f"CASE WHEN strpos(coalesce({url}, ''), '://') > 0 THEN substr({url}, strpos({url}, '://') + 3) ELSE '' END"
        return f"translate(regexp_extract({rest}, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1) AS path"

    def node(url: str) -> str:
        return f"regexp_replace(lower(regexp_extract({url}, '^(.*?://[^/?#]*)', 1)) || regexp_extract({url}, '^.*?://[^/?#]*(.*)$', 1), '#.*$', '')"

    return rf"""
    WITH RECURSIVE rules(verdict, h, p, rule) AS (VALUES {values}),
    pages1 AS (SELECT page_id, url, {parts("url")}, {node("url")} AS node, coalesce(html, '') AS html FROM pages),
    named AS (
        SELECT url, node, regexp_extract(unnest(list_filter(regexp_extract_all(html, '(?is)<link\b[^>]*>'), lambda t: regexp_matches(t, '(?i)\srel\s*=\s*["'']?canonical\b'))), '(?is)\shref\s*=\s*["'']?([^"''\s>]+)', 1) AS t FROM pages1 WHERE node <> ''
        UNION ALL
        SELECT url, node, regexp_extract(unnest(list_filter(regexp_extract_all(html, '(?is)<meta\b[^>]*>'), lambda t: regexp_matches(t, '(?i)\shttp-equiv\s*=\s*["'']?refresh\b'))), '(?is)["'';,\s]url\s*=\s*["'']?([^"''\s>]+)', 1) FROM pages1 WHERE node <> ''),
    whole AS (
        SELECT node AS a, CASE WHEN starts_with(t, '//') THEN regexp_extract(url, '^([^:]*:)//', 1) || t WHEN starts_with(t, '/') THEN regexp_extract(node, '^(.*?://[^/?#]*)', 1) || t WHEN strpos(t, '://') > 0 THEN t END AS t
        FROM (SELECT url, node, trim(replace(t, '&amp;', '&')) AS t FROM named)),
    links AS (SELECT a, {node("t")} AS b FROM whole WHERE t IS NOT NULL),
    both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
    reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a),
    urls AS (SELECT DISTINCT u AS node, {parts("u")} FROM (SELECT a AS u FROM reach)),
    judged AS (
        SELECT node, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
        FROM (SELECT node, host, path FROM urls UNION SELECT node, host, path FROM pages1 WHERE node <> '') JOIN rules ON (host = h OR suffix(host, '.' || h)) AND starts_with(path, p) GROUP BY node),
    around AS (SELECT a AS node, bool_or(verdict = 'block') AND NOT bool_or(verdict = 'allow') AS blocked FROM reach JOIN judged ON judged.node = b GROUP BY a)
    SELECT page_id, host, path, rule, CASE WHEN verdict IS NOT NULL THEN verdict WHEN blocked THEN 'block' ELSE 'allow' END AS verdict,
           verdict IS NULL AND coalesce(blocked, false) AS via_alias
    FROM pages1 LEFT JOIN judged USING (node) LEFT JOIN around USING (node)"""
