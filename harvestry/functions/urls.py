"""URL and scalar functions as native columns: no Python in the row path.

Strings follow the WHATWG view of http(s) addresses: scheme and host in lower
case, default port dropped, dot segments removed, an empty path is "/".
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Public suffixes of more than one label that the built-in table knows; a full list is a parameter.
SUFFIXES = frozenset(
    "co.uk org.uk ac.uk gov.uk ltd.uk plc.uk me.uk net.uk com.au net.au org.au edu.au gov.au co.nz org.nz net.nz govt.nz co.jp or.jp ne.jp ac.jp go.jp"
    " com.br net.br org.br gov.br co.in net.in org.in gov.in com.cn net.cn org.cn gov.cn co.za org.za com.mx org.mx com.ar com.tr com.sg com.hk com.tw co.kr or.kr com.ua co.il org.il com.pl".split()
)
# Words in the address of a logout page.
LOGOUT = ["logout", "log-out", "log_out", "signout", "sign-out", "sign_out", "deconnexion", "cerrar sesion", "abmelden", "uitloggen", "ausloggen", "disconnect", "end-session", "end session", "wyloguj", "sign-off"]
# Names of common JavaScript libraries.
JS_LIBRARIES = ["jquery", "angular", "bootstrap", "vue", "react", "lodash", "moment", "d3", "three", "socket.io", "backbone", "underscore", "modernizr", "polyfill"]
STATIC_SUFFIXES = [".js", ".css", ".json", ".xml", ".txt"]


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(c: str | Column) -> Column:
    """Strings are never null in the model: null is empty."""
    return F.coalesce(col(c), F.lit(""))


def strip(u: str | Column) -> Column:
    """Without white space and control characters around it."""
    return F.regexp_replace(col(u), r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def scheme(u: str | Column) -> Column:
    return F.lower(F.regexp_extract(strip(u), r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))


def host(u: str | Column) -> Column:
    authority = F.regexp_extract(strip(u), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1)
    return F.lower(F.regexp_replace(authority, r":[0-9]*$", ""))


def port(u: str | Column) -> Column:
    """Explicit port that is not the scheme's default; empty otherwise."""
    p = F.regexp_extract(strip(u), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?[^/?#]*?:([0-9]+)(?:[/?#]|$)", 1)
    s = scheme(u)
    return F.when(((s == "http") & (p == "80")) | ((s == "https") & (p == "443")), "").otherwise(p)


def raw_path(u: str | Column) -> Column:
    return F.regexp_extract(strip(u), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def without_dots(p: Column) -> Column:
    """Path without "." and ".." segments."""

    def step(acc: Column, x: Column) -> Column:
        up = F.when(F.size(acc) > 1, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))).otherwise(acc)
        low = F.lower(x)
        return F.when(low.isin(".", "%2e"), acc).when(low.isin("..", ".%2e", "%2e.", "%2e%2e"), up).otherwise(F.concat(acc, F.array(x)))

    parts = F.split(p, "/")
    last = F.lower(F.element_at(parts, -1))
    # the empty string before the leading slash stays first
    joined = F.array_join(F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(F.lit("")), step), "/")
    slash = last.isin(".", "..", "%2e", ".%2e", "%2e.", "%2e%2e")
    return F.when(p.rlike(r"(?i)/(?:\.|%2e){1,2}(?:/|$)"), F.when(slash, F.concat(joined, F.lit("/"))).otherwise(joined)).otherwise(p)


def percent_encode(p: Column) -> Column:
    """What may not stand in a path or query, as UTF-8 percent triplets."""
    each = F.transform(F.split(p, "(?!^)"), lambda c: F.when(c.rlike(r"^[\x21\x23-\x3b\x3d\x3f-\x5f\x61-\x7a\x7c\x7e]$"), c).otherwise(F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")))
    return F.when(p.rlike(r"[^\x21\x23-\x3b\x3d\x3f-\x5f\x61-\x7a\x7c\x7e]"), F.array_join(each, "")).otherwise(p)


def path(u: str | Column) -> Column:
    p = raw_path(u)
    return F.when(p == "", "/").otherwise(percent_encode(without_dots(p)))


def query(u: str | Column) -> Column:
    return F.regexp_extract(strip(u), r"^[^?#]*\?([^#]*)", 1)


def fragment(u: str | Column) -> Column:
    return F.regexp_extract(strip(u), r"(?s)#(.*)$", 1)


def authority(u: str | Column) -> Column:
    """host[:port]"""
    p = port(u)
    return F.concat(host(u), F.when(p == "", "").otherwise(F.concat(F.lit(":"), p)))


def root(u: str | Column) -> Column:
    """scheme://host[:port]"""
    return F.concat(scheme(u), F.lit("://"), authority(u))


def normalize(u: str | Column, keep_fragment: bool = True, keep_query: bool = True) -> Column:
    """The address in normal form; null where it is none."""
    u = col(u)
    out = F.concat(root(u), path(u))
    if keep_query:
        out = F.concat(out, F.when(u.rlike(r"^[^#]*\?"), F.concat(F.lit("?"), percent_encode(query(u)))).otherwise(""))
    if keep_fragment:
        out = F.concat(out, F.when(u.contains("#"), F.concat(F.lit("#"), fragment(u))).otherwise(""))
    return F.when((scheme(u) != "") & (host(u) != ""), out)


def _reference(bs: Column, br: Column, bp: Column, bq: Column, ref: Column) -> Column:
    """The whole address ref stands for, before it is put in normal form; base given as scheme, root, path and ?query."""
    bare = F.regexp_replace(ref, "(?s)#.*$", "")
    folder = F.regexp_replace(F.when(bp == "", "/").otherwise(bp), r"[^/]*$", "")
    return (
        F.when(bare.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), bare)
        .when(bare.startswith("//"), F.concat(bs, F.lit(":"), bare))
        .when(bare.startswith("/"), F.concat(br, bare))
        .when(bare == "", F.concat(br, bp, bq))
        .when(bare.startswith("?"), F.concat(br, bp, bare))
        .otherwise(F.concat(br, folder, bare))
    )


def _base_query(b: Column) -> Column:
    return F.when(b.rlike(r"^[^#]*\?"), F.concat(F.lit("?"), query(b))).otherwise("")


def _resolved(whole: Column, ref: Column, keep_query: bool, keep_fragment: bool) -> Column:
    frag = F.when(ref.contains("#"), F.concat(F.lit("#"), F.regexp_extract(ref, r"(?s)#(.*)$", 1))).otherwise("") if keep_fragment else F.lit("")
    return F.when(ref.startswith("#") | (ref == ""), "").otherwise(F.coalesce(F.concat(normalize(whole, keep_fragment=False, keep_query=keep_query), frag), F.lit("")))


def join(base: str | Column, ref: str | Column, keep_query: bool = True, keep_fragment: bool = False) -> Column:
    """ref resolved against base; empty for a bare fragment or where either is no address."""
    b, r = col(base), strip(text(ref))
    return _resolved(_reference(scheme(b), root(b), raw_path(b), _base_query(b), r), r, keep_query, keep_fragment)


def joined(df: DataFrame, name: str, base: str | Column, ref: str | Column, keep_query: bool = True, keep_fragment: bool = False) -> DataFrame:
    """df with column `name`: join in steps, each part a column of its own, so that no pattern is run twice on a row."""
    b = col(base)
    parts = {"_bs": scheme(b), "_br": root(b), "_bp": raw_path(b), "_bq": _base_query(b), "_ref": strip(text(ref))}
    df = df.withColumns(parts)
    df = df.withColumn("_whole", _reference(F.col("_bs"), F.col("_br"), F.col("_bp"), F.col("_bq"), F.col("_ref")))
    df = df.withColumn(name, _resolved(F.col("_whole"), F.col("_ref"), keep_query, keep_fragment))
    return df.drop(*parts, "_whole")


def visited_key(u: str | Column, method: str | Column, body: str | Column, ignore_query: bool = False) -> Column:
    n = normalize(u, keep_fragment=False, keep_query=not ignore_query)
    return F.when(F.upper(text(method)) == "POST", F.concat(n, F.lit(":"), text(body))).otherwise(n)


def request_url(u: str | Column, method: str | Column, body: str | Column) -> Column:
    return F.when(col(method) == "GET", col(u)).when(col(method) == "POST", F.concat(col(u), F.lit(":"), text(body))).otherwise("")


def registrable_domain(h: str | Column, suffixes: frozenset[str] | set[str] = SUFFIXES) -> Column:
    """eTLD+1 of a host; a host that is itself a suffix stays."""
    h = F.lower(col(h))
    two, three = F.substring_index(h, ".", -2), F.substring_index(h, ".", -3)
    return F.when(h.rlike(r"^[0-9.]+$") | h.contains(":"), h).when(two.isin(*sorted(suffixes)), three).otherwise(two)


def load_suffixes(path: str) -> frozenset[str]:
    """Public suffixes of two labels from a list in the usual format, for registrable_domain; wildcard and exception rules are passed over."""
    with open(path, encoding="utf-8") as f:
        rules = (x.strip() for x in f)
        return frozenset(x for x in rules if x and not x.startswith(("//", "*", "!")) and x.count(".") == 1)


def encode_component(c: str | Column) -> Column:
    """Every byte but letters and digits as %XX."""
    out = F.regexp_replace(F.url_encode(col(c)), r"\+", "%20")
    for ch, code in (("*", "%2A"), ("-", "%2D"), ("_", "%5F"), (".", "%2E")):
        out = F.replace(out, F.lit(ch), F.lit(code))
    return out


def decode_component(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), c)


def file_base(p: str | Column) -> Column:
    """Last path component if it has a dot; empty otherwise."""
    last = F.substring_index(F.regexp_replace(col(p), "/+$", ""), "/", -1)
    return F.when(last.contains("."), last).otherwise("")


def directory(p: str | Column) -> Column:
    """Path up to the last slash, if that is not the first; empty otherwise."""
    d = F.regexp_extract(col(p), r"^(/.*/)", 1)
    return F.when(F.length(d) > 1, d).otherwise("")


def extension(p: str | Column) -> Column:
    """File extension with its dot, lower case; empty for none and for dot files."""
    last = F.substring_index(F.regexp_replace(col(p), "/+$", ""), "/", -1)
    return F.lower(F.regexp_extract(last, r"^.+(\.[^.]*)$", 1))


def normalize_extension(e: str) -> str:
    e = e.strip().lower()
    return "" if e in ("", "none") else e if e.startswith(".") else "." + e


def query_pairs(q: str | Column) -> Column:
    """array<struct<pos,k,v>> of the decoded pairs of a query."""
    plus = lambda c: F.replace(c, F.lit("+"), F.lit(" "))
    pieces = F.filter(F.split(col(q), "&"), lambda x: x != "")
    return F.transform(
        pieces,
        lambda x, i: F.struct(
            i.alias("pos"),
            decode_component(plus(F.substring_index(x, "=", 1))).alias("k"),
            F.when(x.contains("="), decode_component(plus(F.regexp_replace(x, r"^[^=]*=", "")))).otherwise("").alias("v"),
        ),
    )


def form_encode(c: Column) -> Column:
    """application/x-www-form-urlencoded"""
    return F.url_encode(c)


def sorted_query_path(u: str | Column) -> Column:
    """path?query with the pairs in order of their keys, encoded again; the path alone without pairs."""
    pairs = F.array_sort(F.transform(query_pairs(query(u)), lambda x: F.struct(x["k"].alias("k"), x["pos"].alias("pos"), x["v"].alias("v"))))
    text_ = F.array_join(F.transform(pairs, lambda x: F.concat(form_encode(x["k"]), F.lit("="), form_encode(x["v"]))), "&")
    return F.when(F.size(pairs) > 0, F.concat(path(u), F.lit("?"), text_)).otherwise(path(u))


def normalize_segment(s: Column) -> Column:
    """Placeholder of an identifier-like path segment, the segment itself otherwise."""
    hexa = lambda n: s.rlike(rf"^[0-9a-fA-F]{{{n}}}$") & s.rlike("[a-fA-F]")
    return (
        F.when(s.rlike(r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"), "{uuid}")
        .when(hexa(64), "{sha256}")
        .when(hexa(40), "{sha1}")
        .when(hexa(32), "{md5}")
        .when(hexa(24), "{oid}")
        .when(hexa("8,"), "{hex}")
        .when(s.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), "{date}")
        .when(s.rlike(r"^[0-9]{10}(?:[0-9]{3})?$"), "{ts}")
        .when(s.rlike(r"^[0-9]+$"), "{num}")
        .otherwise(s)
    )


def segments(u: str | Column) -> Column:
    return F.filter(F.split(F.regexp_replace(path(u), "^/+|/+$", ""), "/"), lambda x: x != "")


def fingerprint(u: str | Column, segs: Column | None = None) -> Column:
    """Shape of an address: identifiers as placeholders, sorted distinct query keys.  segs: segments already levelled by a trie."""
    s = F.transform(segments(u), normalize_segment) if segs is None else segs
    p = F.concat(F.lit("/"), F.array_join(s, "/"), F.when((F.size(s) > 0) & path(u).endswith("/"), "/").otherwise(""))
    keys = F.array_sort(F.array_distinct(F.transform(query_pairs(query(u)), lambda x: x["k"])))
    return F.concat(root(u), p, F.when(F.size(keys) > 0, F.concat(F.lit("?"), F.array_join(keys, "&"))).otherwise(""))


def is_logout(u: str | Column) -> Column:
    return any_of([F.lower(col(u)).contains(w) for w in LOGOUT])


def is_js_library(p: str | Column) -> Column:
    return any_of([F.lower(col(p)).contains(w) for w in JS_LIBRARIES])


def is_static(p: str | Column) -> Column:
    return any_of([F.lower(col(p)).endswith(s) for s in STATIC_SUFFIXES])


def is_redirect(status: str | Column) -> Column:
    return col(status).between(300, 399)


def in_domain(h: str | Column, domain: str | Column) -> Column:
    """Equal to the domain or under it, whatever the case."""
    h, d = F.lower(col(h)), F.lower(col(domain))
    return (h == d) | h.endswith(F.concat(F.lit("."), d))


def response_hash(u: str | Column) -> Column:
    return F.md5(F.encode(col(u), "UTF-8"))


def response_host(u: str | Column) -> Column:
    return F.replace(authority(u), F.lit(":"), F.lit("_"))


def export_filename(u: str | Column) -> Column:
    return F.concat(F.replace(F.replace(F.replace(col(u), F.lit("https://"), F.lit("")), F.lit("http://"), F.lit("")), F.lit("/"), F.lit("_")), F.lit(".md"))


def rfc3339(ts: str | Column) -> Column:
    return F.date_format(col(ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def civil_from_days(days: str | Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), col(days).cast("int"))


def duration_seconds(c: str | Column) -> Column:
    """Go-style durations ("1h30m", "250ms", "1.5s") in seconds; empty is 0, anything else that does not parse is null."""
    c = F.trim(col(c))
    unit = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0, "d": 86400.0}
    table = F.create_map(*[x for k, v in unit.items() for x in (F.lit(k), F.lit(v))])
    found = F.regexp_extract_all(c, F.lit(r"([0-9]+(?:\.[0-9]+)?(?:ns|us|µs|ms|s|m|h|d))"), F.lit(1))
    each = F.transform(found, lambda x: F.regexp_extract(x, r"^([0-9.]+)", 1).cast("double") * F.element_at(table, F.regexp_extract(x, r"([a-zµ]+)$", 1)))
    total = F.aggregate(each, F.lit(0.0), lambda a, x: a + x)
    return F.when(c == "", F.lit(0.0)).when(c.rlike(r"^(?:[0-9]+(?:\.[0-9]+)?(?:ns|us|µs|ms|s|m|h|d))+$"), total)


def with_scheme(c: str | Column) -> Column:
    c = col(c)
    return F.when(c.startswith("http://") | c.startswith("https://"), c).otherwise(F.concat(F.lit("https://"), c))


def websocket_url(c: str | Column) -> Column:
    """ws(s) address of a debugging endpoint given as http(s), ws(s) or host:port."""
    c = F.trim(col(c))
    return (
        F.when(c.startswith("ws://") | c.startswith("wss://"), c)
        .when(c.startswith("https://"), F.concat(F.lit("wss://"), F.substring(c, 9, 1 << 20)))
        .when(c.startswith("http://"), F.concat(F.lit("ws://"), F.substring(c, 8, 1 << 20)))
        .otherwise(F.concat(F.lit("ws://"), c))
    )
