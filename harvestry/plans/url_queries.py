"""Queries on addresses, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import dedup, extract, filters, output
from . import tables as T

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_T = "trim(url, ' ' || chr(9) || chr(10) || chr(13))"
_S = rf"lower(regexp_extract({_T}, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1))"
_A = rf"regexp_extract({_T}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)', 1)"
_H = rf"lower(regexp_replace({_A}, ':[0-9]*$', ''))"
_P0 = rf"regexp_extract({_A}, ':([0-9]+)$', 1)"
_P = rf"CASE WHEN ({_S} = 'http' AND {_P0} = '80') OR ({_S} = 'https' AND {_P0} = '443') THEN '' ELSE {_P0} END"
_PATH = rf"CASE WHEN regexp_extract({_T}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract({_T}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) END"
_QUERY = rf"regexp_extract({_T}, '^[^?#]*\?([^#]*)', 1)"
_ROOT = rf"({_S} || '://' || {_H} || CASE WHEN ({_P}) = '' THEN '' ELSE ':' || ({_P}) END)"
_NORM = rf"({_ROOT} || ({_PATH}) || CASE WHEN regexp_matches(url, '^[^#]*\?') THEN '?' || {_QUERY} ELSE '' END)"
_FILE = rf"string_split(rtrim({_PATH}, '/'), '/')[-1]"
_DIR = rf"regexp_extract({_PATH}, '^(/.*/)', 1)"
_PAIRS = rf"list_filter(string_split({_QUERY}, '&'), lambda x: x <> '')"
_K = "url_decode(replace(string_split(x, '=')[1], '+', ' '))"
_V = "CASE WHEN contains(x, '=') THEN url_decode(replace(regexp_replace(x, '^[^=]*=', ''), '+', ' ')) ELSE '' END"
_E = "replace(replace(replace(url_encode({0}), '%20', '+'), '%2A', '*'), '~', '%7E')"
_SUFFIXES = ", ".join(f"'{s}'" for s in sorted(U.SUFFIXES))


def _rdn(h: str) -> str:
    return f"CASE WHEN array_to_string(string_split({h}, '.')[-2:], '.') IN ({_SUFFIXES}) THEN array_to_string(string_split({h}, '.')[-3:], '.') ELSE array_to_string(string_split({h}, '.')[-2:], '.') END"


@query(f"SELECT response_id, {_S} AS scheme, {_H} AS host, {_P} AS port, {_PATH} AS path, {_QUERY} AS query, regexp_extract({_T}, '#(.*)$', 1) AS fragment, {_NORM} AS normal FROM {T.RESPONSES}")
def url_parts(spark: SparkSession, d: str) -> DataFrame:
    r = T.responses(spark, d)
    return T.once(r.select("response_id", U.scheme("url").alias("scheme"), U.host("url").alias("host"), U.port("url").alias("port"), U.path("url").alias("path"), U.query("url").alias("query"), U.fragment("url").alias("fragment"), U.normalize("url", keep_fragment=False).alias("normal")))


@query(
    f"""WITH r AS (SELECT response_id, url, {_PAIRS} AS pairs, {_FILE} AS f, {_DIR} AS dd FROM {T.RESPONSES})
SELECT response_id, 'url' AS field, url AS value FROM r
UNION ALL SELECT response_id, 'path', {_PATH} FROM r UNION ALL SELECT response_id, 'fqdn', {_H} FROM r
UNION ALL SELECT response_id, 'rdn', {_rdn(_H)} FROM r UNION ALL SELECT response_id, 'rurl', {_ROOT} FROM r
UNION ALL SELECT response_id, 'qurl', url FROM r WHERE len(pairs) > 0
UNION ALL SELECT response_id, 'qpath', {_PATH} || '?' || array_to_string(list_transform(list_sort(list_transform(pairs, lambda x, i: {{'k': {_K}, 'pos': i, 'v': {_V}}})), lambda y: {_E.format("y.k")} || '=' || {_E.format("y.v")}), '&') FROM r WHERE len(pairs) > 0
UNION ALL SELECT response_id, 'file', f FROM r WHERE contains(f, '.') UNION ALL SELECT response_id, 'ufile', url FROM r WHERE contains(f, '.')
UNION ALL SELECT response_id, 'key', unnest(list_transform(pairs, lambda x: {_K})) FROM r
UNION ALL SELECT response_id, 'value', unnest(list_transform(pairs, lambda x: {_V})) FROM r
UNION ALL SELECT response_id, 'kv', unnest(list_transform(pairs, lambda x: {_K} || '=' || {_V})) FROM r
UNION ALL SELECT response_id, 'dir', dd FROM r WHERE length(dd) > 1 UNION ALL SELECT response_id, 'udir', {_ROOT} || dd FROM r WHERE length(dd) > 1"""
)
def url_fields(spark: SparkSession, d: str) -> DataFrame:
    return T.each(T.responses(spark, d), "response_id", output.field_values("url"), "x").select("response_id", "x.field", "x.value")


@query(f"SELECT item_id, {_rdn(_H)} AS rdn, {_FILE} AS last, CASE WHEN contains({_FILE}, '.') THEN {_FILE} ELSE '' END AS file, lower(regexp_extract({_FILE}, '^.+(\\.[^.]*)$', 1)) AS ext, {_H} || CASE WHEN ({_P}) = '' THEN '' ELSE '_' || ({_P}) END AS store_host, md5(url) AS hash FROM {T.ITEMS}")
def url_names(spark: SparkSession, d: str) -> DataFrame:
    p = U.path("url")
    last = F.substring_index(F.regexp_replace(p, "/+$", ""), "/", -1)
    return T.once(T.items(spark, d).select("item_id", U.registrable_domain(U.host("url")).alias("rdn"), last.alias("last"), U.file_base(p).alias("file"), U.extension(p).alias("ext"), U.response_host("url").alias("store_host"), U.response_hash("url").alias("hash")))


@query(f"SELECT item_id, CASE WHEN upper(method) = 'POST' THEN {_NORM} || ':' || coalesce(body, '') ELSE {_NORM} END AS visited, CASE method WHEN 'GET' THEN url WHEN 'POST' THEN url || ':' || coalesce(body, '') ELSE '' END AS request FROM {T.ITEMS}")
def request_keys(spark: SparkSession, d: str) -> DataFrame:
    return T.once(T.items(spark, d).select("item_id", U.visited_key("url", "method", "body").alias("visited"), U.request_url("url", "method", "body").alias("request")))


_DENY = ", ".join(f"'{e}'" for e in filters.DENIED_EXTENSIONS)
_EXT = f"lower(regexp_extract({_FILE}, '^.+(\\.[^.]*)$', 1))"


@query(f"SELECT item_id, {_EXT} NOT IN ({_DENY}) AS by_default, {_EXT} IN ('.html', '') AS listed, {_EXT} NOT IN ('.html') AS denied FROM {T.ITEMS}")
def extension_filter(spark: SparkSession, d: str) -> DataFrame:
    p = U.path("url")
    return T.once(T.items(spark, d).select("item_id", filters.extension_allowed(p).alias("by_default"), filters.extension_allowed(p, ["html", "none"]).alias("listed"), filters.extension_allowed(p, deny=["HTML"], defaults=False).alias("denied")))


@query(
    f"""WITH s AS (SELECT min_by({_H}, item_id) AS seed FROM {T.ITEMS}), r AS (SELECT item_id, {_H} AS h, url FROM {T.ITEMS})
SELECT item_id, (h = {_rdn("seed")} OR ends_with(h, '.' || {_rdn("seed")})) AS rdn, contains(h, string_split({_rdn("seed")}, '.')[1]) AS dn, h = seed AS fqdn,
regexp_matches(h, '^(?:docs|shop)\\.') AS pattern, NOT regexp_matches(url, '/help/') AND (regexp_matches(url, 'id=') OR regexp_matches(url, '\\.html$')) AS address FROM r, s"""
)
def scopes(spark: SparkSession, d: str) -> DataFrame:
    r = T.once(T.items(spark, d).select("item_id", "url", U.host("url").alias("h")))
    seed = F.lit(r.agg(F.min_by("h", "item_id")).first()[0])  # the first item's host
    return r.select(
        "item_id",
        filters.in_scope("h", seed, "rdn").alias("rdn"),
        filters.in_scope("h", seed, "dn").alias("dn"),
        filters.in_scope("h", seed, "fqdn").alias("fqdn"),
        filters.in_scope("h", seed, r"^(?:docs|shop)\.").alias("pattern"),
        filters.url_in_scope("url", ["id=", r"\.html$"], ["/help/"]).alias("address"),
    )


_IP = "(c_custkey * 7919) % 256 || '.' || (c_custkey * 104729) % 256 || '.' || (c_custkey * 31) % 256 || '.' || c_custkey % 256"
_NUM = "(((c_custkey * 7919) % 256)::BIGINT * 16777216 + ((c_custkey * 104729) % 256) * 65536 + ((c_custkey * 31) % 256) * 256 + c_custkey % 256)"


@query(
    f"""WITH x AS (SELECT c_custkey, {_NUM} AS n, c_custkey % 3 = 0 AS p FROM customer)
SELECT c_custkey, NOT (p OR n >> 24 IN (0, 10, 127) OR n >> 22 = 401 OR n >> 16 IN (43518, 49320) OR n >> 20 = 2753 OR n >> 8 = 12582912 OR n >> 17 = 25353) AS allowed FROM x"""
)
def exclusions(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    ip = F.concat_ws(".", (k * 7919) % 256, (k * 104729) % 256, (k * 31) % 256, k % 256)
    u = F.concat(F.lit("http://"), ip, F.when(k % 3 == 0, ":8081").otherwise(""), F.lit("/x"))
    return T.read(spark, d, "customer").select("c_custkey", filters.not_excluded(u, ["private-ips", "8081", "cdn"]).alias("allowed"))


@query(f"SELECT item_id, url FROM (SELECT *, row_number() OVER (PARTITION BY {_H} ORDER BY item_id) AS rn FROM {T.ITEMS}) WHERE rn <= 5")
def host_page_cap(spark: SparkSession, d: str) -> DataFrame:
    return filters.host_cap(T.once(T.items(spark, d).select("item_id", "url", U.host("url").alias("h"))), "h", ["item_id"], 5).drop("h")


@query(f"SELECT min(item_id) AS item_id FROM (SELECT item_id, {_ROOT} || ({_PATH}) AS k FROM {T.ITEMS}) GROUP BY k")
def ignore_query_dedup(spark: SparkSession, d: str) -> DataFrame:
    x = T.once(T.items(spark, d).select("item_id", U.normalize("url", keep_fragment=False, keep_query=False).alias("k")))
    return dedup.first_by(x, ["k"], ["item_id"]).select("item_id")


_SEG = """CASE WHEN regexp_matches(s, '^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$') THEN '{uuid}'
WHEN regexp_matches(s, '^[0-9a-fA-F]{64}$') AND regexp_matches(s, '[a-fA-F]') THEN '{sha256}' WHEN regexp_matches(s, '^[0-9a-fA-F]{40}$') AND regexp_matches(s, '[a-fA-F]') THEN '{sha1}'
WHEN regexp_matches(s, '^[0-9a-fA-F]{32}$') AND regexp_matches(s, '[a-fA-F]') THEN '{md5}' WHEN regexp_matches(s, '^[0-9a-fA-F]{24}$') AND regexp_matches(s, '[a-fA-F]') THEN '{oid}'
WHEN regexp_matches(s, '^[0-9a-fA-F]{8,}$') AND regexp_matches(s, '[a-fA-F]') THEN '{hex}' WHEN regexp_matches(s, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') THEN '{date}'
WHEN regexp_matches(s, '^[0-9]{10}([0-9]{3})?$') THEN '{ts}' WHEN regexp_matches(s, '^[0-9]+$') THEN '{num}' ELSE s END"""
_SEGS = f"list_filter(string_split({_PATH}, '/'), lambda s: s <> '')"


@query(
    f"""WITH x AS (SELECT item_id, unnest([md5(url), substr(md5(url), 1, 24), substr(md5(url), 1, 9), md5(url) || md5(body), item_id::VARCHAR, '2024-01-' || lpad((item_id % 28 + 1)::VARCHAR, 2, '0'),
(1700000000 + item_id)::VARCHAR, (1700000000000 + item_id)::VARCHAR, regexp_replace(md5(url), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5'), substr(md5(url), 1, 5)]) AS s FROM (SELECT item_id, url, coalesce(body, '') AS body FROM {T.ITEMS}))
SELECT item_id, s AS segment, {_SEG} AS shape FROM x"""
)
def segment_shapes(spark: SparkSession, d: str) -> DataFrame:
    m, i = F.md5("url"), F.col("item_id")
    cells = [m, F.substring(m, 1, 24), F.substring(m, 1, 9), F.concat(m, F.md5(F.coalesce("body", F.lit("")))), i.cast("string"), F.concat(F.lit("2024-01-"), F.lpad((i % 28 + 1).cast("string"), 2, "0")), (F.lit(1700000000) + i).cast("string"), (F.lit(1700000000000) + i).cast("string"), F.regexp_replace(m, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.substring(m, 1, 5)]
    x = T.each(T.items(spark, d), "item_id", F.array(*cells), "segment")
    return x.select("item_id", "segment", U.normalize_segment(F.col("segment")).alias("shape"))


_SHAPES = f"list_transform({_SEGS}, lambda s: {_SEG})"
_KEYS = f"list_sort(list_distinct(list_transform({_PAIRS}, lambda x: {_K})))"


def _finger(segs: str) -> str:
    return f"{_ROOT} || '/' || array_to_string({segs}, '/') || CASE WHEN len({segs}) > 0 AND ends_with({_PATH}, '/') THEN '/' ELSE '' END || CASE WHEN len({_KEYS}) > 0 THEN '?' || array_to_string({_KEYS}, '&') ELSE '' END"


@query(f"SELECT item_id, {_finger(_SHAPES)} AS fingerprint FROM {T.ITEMS}")
def fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return T.once(T.items(spark, d).select("item_id", U.fingerprint("url").alias("fingerprint")))


def _trie_sql(threshold: int, levels: int = 8) -> str:
    sql = f"WITH l0 AS (SELECT item_id, url, {_H} AS h, {_SHAPES} AS s, []::VARCHAR[] AS done FROM {T.ITEMS})"
    for i in range(levels):
        sql += f""", f{i} AS (SELECT h, done, s[{i + 1}] AS seg, min(item_id) AS f FROM l{i} WHERE len(s) > {i} GROUP BY ALL),
t{i} AS (SELECT h, done, f AS t FROM (SELECT *, row_number() OVER (PARTITION BY h, done ORDER BY f) AS rn FROM f{i}) WHERE rn = {threshold + 1}),
l{i + 1} AS (SELECT item_id, url, l.h, l.s, CASE WHEN len(l.s) > {i} THEN list_append(l.done, CASE WHEN t IS NOT NULL AND item_id >= t THEN '{{param}}' ELSE l.s[{i + 1}] END) ELSE l.done END AS done FROM l{i} l LEFT JOIN t{i} ON l.h = t{i}.h AND l.done = t{i}.done)"""
    return sql + f" SELECT min(item_id) AS item_id, fingerprint FROM (SELECT item_id, {_finger('done')} AS fingerprint FROM l{levels}) GROUP BY fingerprint"


@query(_trie_sql(3))
def filter_similar(spark: SparkSession, d: str) -> DataFrame:
    """First request of each shape of address, with paths levelled by the host's tree."""
    r = T.once(T.items(spark, d).select("item_id", "url"))
    shaped = r.select("item_id", U.host("url").alias("h"), F.transform(U.segments("url"), U.normalize_segment).alias("s"))
    t = dedup.trie_paths(shaped, "item_id", "h", "s", 3)
    x = r.join(t, "item_id").select("item_id", U.fingerprint("url", F.col("segments")).alias("fingerprint"))
    return dedup.first_by(x, ["fingerprint"], ["item_id"])


@query(f"WITH r AS (SELECT response_id, {_ROOT} AS root, {_SEGS} AS s FROM {T.RESPONSES}) SELECT response_id, i::INTEGER AS place, root || '/' || array_to_string(s[1:i], '/') || '/' AS folder FROM (SELECT *, unnest(generate_series(1, len(s) - 1)) AS i FROM r)")
def path_climb(spark: SparkSession, d: str) -> DataFrame:
    return T.each(T.responses(spark, d), "response_id", extract.climb("url"), "i", "folder").select("response_id", (F.col("i") + 1).alias("place"), "folder")


@query(f"SELECT response_id, unnest([{_ROOT} || '/robots.txt', {_ROOT} || '/sitemap.xml']) AS url FROM {T.RESPONSES}")
def known_files(spark: SparkSession, d: str) -> DataFrame:
    return T.each(T.responses(spark, d), "response_id", extract.known_files("url"), "url")


@query(
    f"""SELECT response_id, {_ROOT} || '/a/b' AS absolute, {_S} || '://other.test/x' AS scheme_relative, {_ROOT} || regexp_replace({_PATH}, '[^/]*$', '') || 'next.html?p=2' AS relative,
'' AS fragment, {_ROOT} || ({_PATH}) || '?z=1' AS query_only, {_ROOT} || '/up' AS dots, 'https://x.test/%C3%BCber' AS encoded FROM {T.RESPONSES}"""
)
def url_join(spark: SparkSession, d: str) -> DataFrame:
    r = T.responses(spark, d)
    refs = {"absolute": "/a/b", "scheme_relative": "//other.test/x", "relative": "next.html?p=2", "fragment": "#top", "query_only": "?z=1", "dots": "/a/./b/../../up#x", "encoded": "https://X.test:443/über"}
    for k, v in refs.items():
        r = U.joined(r, k, "url", F.lit(v))
    return T.once(r.select("response_id", *refs))


@query(f"SELECT item_id, regexp_matches(lower(url), 'logout|log-out|signout|disconnect|abmelden') AS logout, regexp_matches(lower({_PATH}), 'jquery|angular|bootstrap|vue|react|lodash|moment|d3|three|socket\\.io|backbone|underscore|modernizr|polyfill') AS library, regexp_matches(lower({_PATH}), '(\\.js|\\.css|\\.json|\\.xml|\\.txt)$') AS static FROM {T.ITEMS}")
def url_flags(spark: SparkSession, d: str) -> DataFrame:
    p = U.path("url")
    return T.once(T.items(spark, d).select("item_id", U.is_logout("url").alias("logout"), U.is_js_library(p).alias("library"), U.is_static(p).alias("static")))


@query("SELECT c_custkey, date '1970-01-01' + (c_custkey * 3)::INTEGER AS day, CASE c_custkey % 5 WHEN 0 THEN 0::DOUBLE WHEN 1 THEN 5400::DOUBLE WHEN 2 THEN 0.25::DOUBLE WHEN 3 THEN 1.5::DOUBLE ELSE NULL END AS seconds, CASE WHEN c_custkey % 2 = 0 THEN 'https://' || lower(c_name) ELSE 'http://' || lower(c_name) END AS url, 'ws://' || lower(c_name) || ':9222' AS ws FROM customer")
def scalar_conversions(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("c_custkey"), F.lower("c_name")
    text = F.element_at(F.array(*[F.lit(x) for x in ("", "1h30m", "250ms", "1.5s", "soon")]), (k % 5 + 1).cast("int"))
    return T.read(spark, d, "customer").select("c_custkey", U.civil_from_days(k * 3).alias("day"), U.duration_seconds(text).alias("seconds"), U.with_scheme(F.when(k % 2 == 0, n).otherwise(F.concat(F.lit("http://"), n))).alias("url"), U.websocket_url(F.concat(n, F.lit(":9222"))).alias("ws"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM events")
def timestamps(spark: SparkSession, d: str) -> DataFrame:
    return T.read(spark, d, "events").select("event_id", U.rfc3339("ts").alias("stamp"))


@query("SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(url_encode(p_name || ' / é-_.~*'), '-', '%2D', 'g'), '_', '%5F', 'g'), '\\.', '%2E', 'g').replace('~', '%7E').replace('*', '%2A') AS encoded FROM part")
def encode_component(spark: SparkSession, d: str) -> DataFrame:
    return T.read(spark, d, "part").select("p_partkey", U.encode_component(F.concat("p_name", F.lit(" / é-_.~*"))).alias("encoded"))


@query(f"SELECT item_id, url FROM (SELECT item_id, CASE WHEN item_id % 3 = 0 THEN url || '/' || repeat('step-' || lpad((item_id % 100)::VARCHAR, 6, '0') || '/', 12) ELSE url || repeat('ab/', 15) END AS url, item_id % 3 = 0 AS long FROM (SELECT DISTINCT ON (item_id) item_id, url FROM {T.ITEMS})) WHERE NOT long")
def cycles(spark: SparkSession, d: str) -> DataFrame:
    """Addresses with an endless path behind them; those that repeat a long unit go."""
    from ..operators import cycles as C

    k = F.col("item_id")
    long = F.concat(F.col("url"), F.lit("/"), F.repeat(F.concat(F.lit("step-"), F.lpad((k % 100).cast("string"), 6, "0"), F.lit("/")), 12))
    x = T.items(spark, d).select("item_id", F.when(k % 3 == 0, long).otherwise(F.concat("url", F.repeat(F.lit("ab/"), 15))).alias("url"))
    return C.without_cycles(T.once(x))
