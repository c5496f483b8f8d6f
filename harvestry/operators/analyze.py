"""Classifiers of response bodies: technologies, secrets, endpoints, captchas, custom fields."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import urls as U
from .extract import header, matches

# Technology markers as (name, header or empty for the body, text).
TECHNOLOGIES = [
    ("WordPress", "", "wp-content"), ("WordPress", "", "wp-includes"), ("Drupal", "", "drupal"), ("Joomla", "", "joomla"),
    ("Next.js", "", "__next"), ("Nuxt", "", "__nuxt"), ("Nuxt", "", "nuxt"), ("React", "", "react"), ("Vue.js", "", "vue"),
    ("Angular", "", "ng-version"), ("Svelte", "", "svelte"), ("jQuery", "", "jquery"), ("Bootstrap", "", "bootstrap"), ("Shopify", "", "shopify"),
    ("Cloudflare", "server", "cloudflare"), ("Nginx", "server", "nginx"), ("Apache", "server", "apache"), ("IIS", "server", "microsoft-iis"), ("LiteSpeed", "server", "litespeed"),
    ("Express", "x-powered-by", "express"), ("Next.js", "x-powered-by", "next.js"), ("PHP", "x-powered-by", "php"), ("ASP.NET", "x-powered-by", "asp.net"),
    ("ASP.NET", "", "__viewstate"), ("Django", "", "csrfmiddlewaretoken"), ("Laravel", "", "laravel_session"), ("Rails", "", "csrf-token"),
    ("Google Analytics", "", "googletagmanager"), ("Google Analytics", "", "google-analytics"),
    ("Vercel", "x-vercel-id", ""), ("Amazon CloudFront", "x-amz-cf-id", ""), ("GitHub Pages", "x-github-request-id", ""),
]

# Patterns of credentials, in order.
SECRETS = [
    ("AWS Access Key", r"AKIA[0-9A-Z]{16}"),
    ("AWS Secret Key", r"""(?i)aws(.{0,20})?(secret|sk)(.{0,20})?['"][0-9a-zA-Z/+]{40}['"]"""),
    ("Google API Key", r"AIza[0-9A-Za-z\\-_]{35}"),
    ("Google OAuth", r"[0-9]+-[0-9A-Za-z_]{32}\.apps\.googleusercontent\.com"),
    ("Slack Token", r"xox[baprs]-[0-9a-zA-Z]{10,48}"),
    ("GitHub Token", r"gh[pousr]_[0-9A-Za-z]{36}"),
    ("JWT", r"eyJ[A-Za-z0-9\-_]{10,}\.[A-Za-z0-9\-_]{10,}\.[A-Za-z0-9\-_]{5,}"),
    ("Stripe Key", r"(sk|pk)_(test|live)_[0-9a-zA-Z]{10,32}"),
    ("Twilio Key", r"SK[0-9a-fA-F]{32}"),
    ("Mailgun Key", r"key-[0-9a-zA-Z]{32}"),
    ("Firebase", r"AAAA[A-Za-z0-9_-]{7}:[A-Za-z0-9_-]{140}"),
    ("Private Key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----"),
    ("Authorization Bearer", r"""(?i)authorization['\"]?\s*[:=]\s*['\"]?Bearer\s+[A-Za-z0-9\-_.=+/]{20,}"""),
]
# What endpoint kinds look like.
ENDPOINT_HINTS = [("/api/", "rest"), ("/rest/", "rest"), ("/graphql", "graphql"), ("/query", "graphql"), (".asmx", "soap"), ("/wsdl", "soap"), ("/xhr/", "xhr"), ("/ajax/", "xhr")]
EMAIL = r"([a-zA-Z0-9._-]+@[a-zA-Z0-9._-]+\.[a-zA-Z0-9_-]+)"
CAPTCHA_KINDS = [(("recaptcha", "g-recaptcha"), "ReCaptchaV2TaskProxyLess"), (("hcaptcha",), "HCaptchaTaskProxyLess"), (("turnstile",), "AntiTurnstileTaskProxyLess")]


def technologies(headers: str | Column, body: str | Column) -> Column:
    """Names in order of the table, each once."""
    low, cells = F.lower(U.text(body)), []
    values = {h: header(headers, h) for h in {t[1] for t in TECHNOLOGIES if t[1]}}
    for name, where, what in TECHNOLOGIES:
        test = low.contains(what) if not where else values[where].isNotNull() if not what else F.lower(F.coalesce(values[where], F.lit(""))).contains(what)
        cells.append(F.when(test, name))
    return F.array_distinct(F.array_compact(F.array(*cells)))


def secrets(body: str | Column, most: int = 10) -> Column:
    """array<struct<type,match>>: at most `most` matches of each pattern, in order."""
    def row(n: str):
        return lambda x: F.struct(F.lit(n).alias("type"), x.alias("match"))

    return F.concat(*[F.transform(F.slice(matches(body, p, 0), 1, most), row(n)) for n, p in SECRETS])


def endpoints(body: str | Column) -> Column:
    """array<struct<type,path>> of address-like words by kind, each once."""
    tokens = F.filter(F.split(U.text(body), r"[^\x21-\x7e]+"), lambda x: (x != "") & (F.length(x) < 200))

    def part(hint: str, kind: str) -> Column:
        return F.transform(F.filter(tokens, lambda x: x.contains(hint)), lambda x: F.struct(F.lit(kind).alias("type"), x.alias("path")))

    return F.array_distinct(F.concat(*[part(h, k) for h, k in ENDPOINT_HINTS]))


def knowledge_base(body: str | Column, with_secrets: bool = True, with_endpoints: bool = True) -> Column:
    """struct<secrets,endpoints>, secrets redacted, empty parts null; null where there is nothing."""
    s = F.transform(secrets(body), lambda x: F.struct(x["type"].alias("type"), F.lit("[REDACTED]").alias("match"))) if with_secrets else F.lit(None).cast("array<struct<type:string,match:string>>")
    e = endpoints(body) if with_endpoints else F.lit(None).cast("array<struct<type:string,path:string>>")
    full = lambda x: F.when(F.size(x) > 0, x)
    return F.when((F.coalesce(F.size(s), F.lit(0)) > 0) | (F.coalesce(F.size(e), F.lit(0)) > 0), F.struct(full(s).alias("secrets"), full(e).alias("endpoints")))


def has_captcha(body: str | Column) -> Column:
    b = F.lower(U.text(body))
    return U.any_of([b.contains(x) for x in ("recaptcha", "hcaptcha", "turnstile", "captcha-container")])


def captcha_kind(body: str | Column) -> Column:
    b, out = F.lower(U.text(body)), F.lit(None).cast("string")
    for marks, kind in reversed(CAPTCHA_KINDS):
        out = F.when(U.any_of([b.contains(m) for m in marks]), kind).otherwise(out)
    return out


def sitekey(body: str | Column) -> Column:
    b, out = U.text(body), F.lit("")
    for m in reversed([r"""data-sitekey="([^"']+)["']""", r"""data-sitekey='([^"']+)["']""", r"""sitekey: '([^"']+)["']"""]):
        found = F.regexp_extract(b, m, 1)
        out = F.when(found != "", found).otherwise(out)
    return F.nullif(out, F.lit(""))


@dataclass
class CustomField:
    """A named extractor: patterns, the part they are put on (body, header or response), and the group to keep."""

    name: str
    regex: list[str] = field(default_factory=list)
    part: str = "response"
    group: int = 0


DEFAULT_FIELDS = [CustomField("email", [EMAIL])]
BUILTIN = "url path fqdn rdn rurl qurl qpath file ufile key value kv dir udir".split()


def check_fields(configs: list[CustomField]) -> list[CustomField]:
    import re

    seen: set[str] = set()
    for c in configs:
        if not re.fullmatch(r"[A-Za-z0-9_-]+", c.name):
            raise ValueError(f"wrong custom field name {c.name}")
        if c.name in BUILTIN or c.name in seen:
            raise ValueError(f"custom field {c.name} is taken")
        seen.add(c.name)
        for r in c.regex:
            re.compile(r)
    return configs


def header_text(headers: str | Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.map_entries(U.col(headers))), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")


def custom_fields(configs: list[CustomField], body: str | Column, headers: str | Column | None = None) -> Column:
    """map<name, values>; fields without a value are absent; repeated values stay."""
    entries = []
    for c in check_fields(configs):
        found = []
        for r in c.regex:
            if c.part in ("header", "response") and headers is not None:
                found.append(matches(F.coalesce(header_text(headers), F.lit("")), r, c.group))
            if c.part in ("body", "response"):
                found.append(matches(body, r, c.group))
        values = F.filter(F.concat(*found) if len(found) > 1 else found[0], lambda x: x != "")
        entries.append(F.struct(F.lit(c.name).alias("key"), values.alias("value")))
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: F.size(e["value"]) > 0))
