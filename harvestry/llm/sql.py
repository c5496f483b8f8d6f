"""SQL of the queries that SQL can express on whole tables."""

SQL: dict[str, str] = {}

_site = r"""regexp_replace(lower(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^www\.', '')"""

SQL["p3_found"] = f"""
WITH p AS (SELECT DISTINCT page_id, {_site} AS site, markdown_ir FROM page_ir WHERE url IS NOT NULL AND page_id IS NOT NULL),
q AS (SELECT * FROM p WHERE site <> ''),
size AS (SELECT site, count(DISTINCT page_id) AS size FROM q GROUP BY site),
l AS (SELECT DISTINCT site, page_id, lower(trim(regexp_replace(line, '[ \\t]+', ' ', 'g'))) AS line
      FROM (SELECT site, page_id, unnest(string_split(markdown_ir, chr(10))) AS line FROM q)),
n AS (SELECT site, line, count(*) AS n FROM l WHERE regexp_matches(line, '[\\p{{L}}\\p{{N}}]') GROUP BY site, line)
SELECT n.site AS site, n.line AS line FROM n JOIN size USING (site) WHERE n >= 5 AND n >= 0.1 * size
"""

_u = r"regexp_replace(regexp_replace(url, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), '(?s)#.*', '')"
_host = r"lower(regexp_replace(regexp_extract(regexp_replace(u, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '^([^/?]*)', 1), '^.*@', ''))"
_key = rf"""CASE WHEN NOT regexp_matches(u, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN u ELSE
 lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' || regexp_extract(u, '://([^/?]*@)', 1)
 || CASE lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) WHEN 'http' THEN regexp_replace({_host}, ':(?:80)?$', '') WHEN 'https' THEN regexp_replace({_host}, ':(?:443)?$', '') ELSE {_host} END
 || regexp_replace(regexp_replace(u, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '^[^/?]*', '') END"""

SQL["p7_found"] = f"""
WITH q AS (SELECT DISTINCT {_key} AS key FROM (SELECT {_u} AS u FROM queue_items WHERE url IS NOT NULL AND method = 'GET')),
t AS (SELECT task_id, min(arrived_at) AS arrived_at, min({_key}) AS key FROM (SELECT task_id, arrived_at, {_u} AS u FROM crawl_tasks WHERE url IS NOT NULL AND task_id IS NOT NULL) GROUP BY task_id),
r AS (SELECT task_id, key, row_number() OVER (PARTITION BY key ORDER BY arrived_at NULLS FIRST, task_id) AS rn FROM t)
SELECT task_id FROM r WHERE rn > 1 OR key IN (SELECT key FROM q)
"""
