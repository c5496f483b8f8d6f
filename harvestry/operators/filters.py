"""Predicates of the crawl, each a column that pushes down: extension, scope, exclusion, page type, caps."""

from __future__ import annotations

import ipaddress
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import urls as U

# Extensions skipped by default.
DENIED_EXTENSIONS = (
    ".3g2 .3gp .7z .apk .arj .avi .axd .bmp .csv .deb .dll .doc .drv .eot .exe .flv .gif .gifv .gz .h264 .ico .iso .jar .jpeg .jpg .lock .m4a .m4v .map .mkv .mov .mp3 .mp4 .mpeg"
    " .mpg .msi .ogg .ogm .ogv .otf .pdf .pkg .png .ppt .psd .rar .rm .rpm .svg .swf .sys .tar.gz .tar .tif .tiff .ttf .txt .vob .wav .webm .webp .wmv .woff .woff2 .xcf .xls .xlsx .zip"
).split()
# Address ranges that "private-ips" stands for.
PRIVATE_RANGES = "0.0.0.0/8 10.0.0.0/8 100.64.0.0/10 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.0.0.0/24 192.168.0.0/16 198.18.0.0/15 ::1/128 fc00::/7 fe80::/10".split()
# What error, captcha and parked pages say.
PAGE_TYPES = {"error": ["page not found", "internal server error"], "captcha": ["recaptcha", "hcaptcha", "turnstile"], "parked": ["domain is for sale", "buy this domain"]}


def extension_allowed(path: str | Column, match: Iterable[str] = (), deny: Iterable[str] = (), defaults: bool = True) -> Column:
    """An allow list wins; else anything not denied passes.  No extension passes unless an allow list lacks "none"."""
    ext = U.extension(path)
    allow = [U.normalize_extension(e) for e in match]
    if allow:
        return ext.isin(allow)
    denied = {U.normalize_extension(e) for e in deny} | (set(DENIED_EXTENSIONS) if defaults else set())
    denied.discard("")
    return ~ext.isin(sorted(denied)) if denied else F.lit(True)


def is_ip(host: str | Column) -> Column:
    return U.col(host).rlike(r"^(?:[0-9]{1,3}(?:\.[0-9]{1,3}){3}|\[?[0-9a-fA-F]*:[0-9a-fA-F:.]*\]?)$")


def in_scope(host: str | Column, root_host: str | Column, mode: str = "rdn", no_scope: bool = False) -> Column:
    """dn: the host has the seed's domain name in it; rdn: same registrable domain or under it; fqdn: the same host; other: a pattern."""
    if no_scope:
        return F.lit(True)
    h, r = F.lower(U.col(host)), F.lower(U.col(root_host))
    same = h == r
    if mode == "dn":
        test = h.contains(F.substring_index(U.registrable_domain(r), ".", 1))
    elif mode == "rdn":
        test = U.in_domain(h, U.registrable_domain(r))
    elif mode == "fqdn":
        test = same
    else:
        test = h.rlike(mode)
    return F.when(is_ip(r) | is_ip(h), same).otherwise(test)


def url_in_scope(url: str | Column, inside: Iterable[str] = (), outside: Iterable[str] = ()) -> Column:
    """Patterns on the whole address: out first, then in, where there is one."""
    u = U.col(url)
    out = U.any_of([u.rlike(p) for p in outside])
    inn = [u.rlike(p) for p in inside]
    return ~out & (U.any_of(inn) if inn else F.lit(True))


def ipv4_number(host: Column) -> Column:
    p = F.split(host, r"\.")
    n = F.lit(0).cast("long")
    for i in range(4):
        n = n * 256 + F.try_element_at(p, F.lit(i + 1)).try_cast("long")
    return F.when(host.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"), n)


def ipv6_digits(host: Column) -> Column:
    """The 32 hexadecimal digits of an IPv6 literal (brackets or not); null for anything else."""
    h = F.regexp_replace(F.lower(host), r"^\[|\]$", "")
    part = lambda c: F.filter(F.split(c, ":"), lambda x: x != "")
    left, right = part(F.substring_index(h, "::", 1)), F.when(h.contains("::"), part(F.regexp_replace(h, r"^.*?::", ""))).otherwise(F.array().cast("array<string>"))
    gap = F.greatest(F.lit(8) - F.size(left) - F.size(right), F.lit(0))
    groups = F.transform(F.concat(left, F.array_repeat(F.lit("0"), gap), right), lambda x: F.lpad(x, 4, "0"))
    return F.when(h.rlike(r"^[0-9a-f:]*:[0-9a-f:]*$") & (F.size(groups) == 8), F.array_join(groups, ""))


def in_ipv6(host: Column, net: ipaddress.IPv6Network) -> Column:
    """Whether the host is an IPv6 literal of the range: whole digits by prefix, the digit the range ends in by its values."""
    digits, whole, rest = ipv6_digits(host), net.prefixlen // 4, net.prefixlen % 4
    text = f"{int(net.network_address):032x}"
    test = digits.startswith(text[:whole]) if whole else digits.isNotNull()
    if rest:
        low = int(text[whole], 16)
        test = test & F.substring(digits, whole + 1, 1).isin([f"{low + i:x}" for i in range(1 << (4 - rest))])
    return F.coalesce(test, F.lit(False))


def not_excluded(url: str | Column, entries: Iterable[str]) -> Column:
    """Deny list of inputs: ranges, addresses, ports, patterns, "private-ips"; "cdn" does nothing."""
    import re

    u = U.col(url)
    ranges, six, hosts, ports, patterns = [], [], [], [], []
    todo = [e.strip() for e in entries]
    while todo:
        e = todo.pop(0)
        if e in ("", "cdn"):
            continue
        if e == "private-ips":
            todo += PRIVATE_RANGES
            continue
        try:
            net = ipaddress.ip_network(e, strict=False)
            (ranges if net.version == 4 else six).append(net)
            continue
        except ValueError:
            pass
        if e.isdigit() and int(e) < 65536:
            ports.append(e)
            continue
        try:
            re.compile(e)
            patterns.append(e)
        except re.error:
            hosts.append(e)
    h = U.host(u)
    n = ipv4_number(h)
    tests = [u.rlike(p) for p in patterns]
    tests += [F.coalesce(n.between(int(x.network_address), int(x.broadcast_address)), F.lit(False)) for x in ranges]
    tests += [in_ipv6(h, x) for x in six]
    explicit = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*?:([0-9]+)(?:[/?#]|$)", 1)
    tests += [explicit == p for p in ports]
    tests += [h == x for x in hosts]
    return ~U.any_of(tests)


def page_type(status: str | Column, body: str | Column, kinds: Iterable[str] = ("error", "captcha", "parked")) -> Column:
    """First of the kinds the page is, null for none."""
    b, out = F.lower(U.text(body)), F.lit(None).cast("string")
    for k in reversed(list(kinds)):
        test = U.any_of([b.contains(x) for x in PAGE_TYPES[k]])
        if k == "error":
            test = test | (U.col(status) >= 400)
        out = F.when(test, k).otherwise(out)
    return out


def host_cap(df: DataFrame, host: str, order: list[str], n: int) -> DataFrame:
    """First n rows of each host in the given order.

    A hot host is cut twice: to n rows in each salt, which runs spread out, then to n of what is left, at most n times
    the salts.
    """
    salts = 32
    salt = F.pmod(F.xxhash64(*order), F.lit(salts))
    first = df.withColumn("_salt", salt).withColumn("_rn", F.row_number().over(Window.partitionBy(host, "_salt").orderBy(*order))).where(F.col("_rn") <= n)
    return first.withColumn("_rn", F.row_number().over(Window.partitionBy(host).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn", "_salt")


def output_filter(url: str | Column, match: Iterable[str] = (), drop: Iterable[str] = ()) -> Column:
    """Any match pattern lets pass, any filter pattern drops."""
    u = U.col(url)
    m = [u.rlike(p) for p in match]
    return (U.any_of(m) if m else F.lit(True)) & ~U.any_of([u.rlike(p) for p in drop])


def disposition(depth: str | Column, max_depth: int, valid: Column, allowed: Column, scoped: Column, error: str | Column | None = None) -> Column:
    """What becomes of a frontier row, the cheap tests first."""
    out = F.when((F.lit(max_depth) > 0) & (U.col(depth) > max_depth), "too deep").when(~valid, "invalid").when(~allowed, "extension").when(~scoped, "url out of scope")
    if error is not None:
        out = out.when(U.text(error) != "", "failed")
    return out.otherwise("result")
