"""DuckDB SQL for the operators that SQL can express: plain joins over everything, as slow as they are exact."""

from __future__ import annotations

from talkgauge.llm import licenses, warc

_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _components(nodes: str, links: str) -> str:
    """CTEs that end in ``low(node, component)``, from CTE names with columns node and a, b."""
    return f"reach(node, other) AS (SELECT node, node FROM {nodes} UNION SELECT l.a, r.other FROM {links} l JOIN reach r ON l.b = r.node), low AS (SELECT node, min(other) AS component FROM reach GROUP BY node)"


def embedding_dedup() -> str:
    fine = "vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
    return f"""
WITH RECURSIVE v AS (SELECT vec_id AS node, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE {fine}),
links AS (SELECT x.node AS a, y.node AS b FROM v x JOIN v y ON x.node <> y.node AND len(x.e) = len(y.e)
  WHERE list_inner_product(x.e, y.e) / sqrt(list_inner_product(x.e, x.e)) / sqrt(list_inner_product(y.e, y.e)) >= 0.95),
{_components("v", "links")}
SELECT e.vec_id, (SELECT count(*) FROM links WHERE a = e.vec_id) AS n_links, coalesce(component, e.vec_id) AS component_id, coalesce(e.vec_id = coalesce(component, e.vec_id), false) AS kept
FROM embeddings e LEFT JOIN low ON e.vec_id = low.node"""


def ngram_jaccard(k: int = 4, percent: int = 85) -> str:
    grams = f"CASE WHEN len(words) = 0 THEN [] WHEN len(words) < {k} THEN [words] ELSE list_transform(range(1, len(words) - {k - 2}), lambda i: words[i:i + {k - 1}]) END"
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id AS node, regexp_extract_all(translate(coalesce(text, ''), '{_CAPITALS}', '{_SMALL}'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT node, unnest({grams}) AS g FROM w),
n AS (SELECT node, count(*) AS n FROM s GROUP BY node),
pairs AS (SELECT x.node AS a, y.node AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.node <> y.node GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.node = a JOIN n y ON y.node = b WHERE 100 * k >= {percent} * (x.n + y.n - k)),
{_components("w", "links")}
SELECT w.node AS doc_id, coalesce(n.n, 0) AS n_shingles, low.component AS component_id FROM w LEFT JOIN n ON n.node = w.node LEFT JOIN low ON low.node = w.node"""


def license_scan() -> str:
    words = lambda line: (
        rf"CASE WHEN regexp_matches({line}, '(?i)^[^\p{{L}}\p{{N}}]*copyright\b') THEN [] ELSE list_filter(regexp_split_to_array(lower({line}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') END"
    )
    lines = lambda body: f"list_transform(string_split({body}, chr(10)), lambda l: {words('l')})"
    rows = licenses.template_rows()
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    listed = ", ".join(f"({quote(r[0])}, {r[1]}, {r[2]}, {r[3]}, {r[4]}, {quote(r[5])}, {quote(r[6])}, {r[7]})" for r in rows)
    return rf"""
WITH t(license, template, size, least, most, w1, w2, times) AS (VALUES {listed}),
d AS (SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, {lines("text")} AS lines, CASE WHEN regexp_matches(text, '\n[ \t]*\n') THEN regexp_split_to_array(text, '\n[ \t]*\n\s*') ELSE [] END AS ps FROM d),
p AS (SELECT doc_id, 'text0' AS part, flatten(lines) AS words FROM l
  UNION ALL SELECT doc_id, 'line' || (i - 1), lines[i] FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM l WHERE len(lines) > 1)
  UNION ALL SELECT doc_id, 'paragraph' || (i - 1), flatten({lines("ps[i]")}) FROM (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM l)),
b AS (SELECT doc_id, part, n, w1, w2, count(*) AS seen FROM
  (SELECT doc_id, part, len(words) - 1 AS n, words[i] AS w1, words[i + 1] AS w2 FROM (SELECT *, unnest(range(1, len(words))) AS i FROM p WHERE len(words) <= (SELECT max(most) + 1 FROM t))) GROUP BY ALL),
m AS (SELECT doc_id, part, license, 2 * sum(least(seen, times)) / (n + size) AS dice FROM b JOIN t ON b.w1 = t.w1 AND b.w2 = t.w2 AND n BETWEEN t.least AND most GROUP BY doc_id, part, n, license, template, size),
best AS (SELECT doc_id, part, license, dice FROM m WHERE dice >= {licenses.THRESHOLD} QUALIFY row_number() OVER (PARTITION BY doc_id, part ORDER BY dice DESC, license) = 1),
g AS (SELECT doc_id, count(*) AS n, array_to_string(list_sort(list(DISTINCT license)), ',') AS licenses, string_agg(part || ':' || license || ':' || CAST(round(dice, 4) AS VARCHAR), ',' ORDER BY part) AS matches FROM best GROUP BY doc_id)
SELECT x.doc_id, coalesce(n, 0) AS n_matches, coalesce(licenses, '') AS licenses, coalesce(matches, '') AS matches FROM documents x LEFT JOIN g ON g.doc_id = x.doc_id"""


def warc_revisits() -> str:
    plain = "regexp_replace(trim(url), '#.*$', '')"
    rest = rf"regexp_replace({plain}, '^(?i)[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(?:www[0-9]*\.)?', '')"
    asked = rf"list_filter(string_split(regexp_extract(r, '\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(lower(p), '{warc.IDLE_PARAMETERS}'))"
    return rf"""
WITH c AS (SELECT page_id, md5(coalesce(html, '')) AS tag, sha1(coalesce(html, '')) AS sha, strlen(coalesce(html, '')) AS size, {rest} AS r FROM pages),
u AS (SELECT *, regexp_replace(lower(regexp_extract(r, '^([^/?]*)', 1)), ':(80|443)$', '') || regexp_replace(regexp_extract(r, '^[^/?]*([^?]*)', 1), '/+$', '') ||
  CASE WHEN len({asked}) > 0 THEN '?' || array_to_string(list_sort({asked}), '&') ELSE '' END AS url FROM c),
j AS (SELECT n.page_id, n.url, n.tag, o.page_id AS of, o.tag AS old, o.sha, o.size FROM (SELECT *, page_id * 60 + 43200 AS at FROM u) n ASOF LEFT JOIN (SELECT *, page_id * 60 AS at FROM u) o ON n.url = o.url AND n.at > o.at)
SELECT page_id, url AS canonical_url, of AS refers_to, CASE WHEN of IS NULL THEN 'unresolved' WHEN tag = old THEN 'etag' ELSE 'mismatch' END AS validator, CASE WHEN tag = old THEN sha END AS digest,
  CASE WHEN tag = old THEN 'age: 0' || chr(10) || 'cache-control: max-age=3600' || chr(10) || 'content-length: ' || size || chr(10) || 'content-type: text/html; charset=utf-8' || chr(10) || 'etag: W/"' || tag || '"' END AS headers FROM j"""
