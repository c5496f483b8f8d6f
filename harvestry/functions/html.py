"""One parse of a page for everything that needs its tree: title, links, forms, Markdown, scripts.

The tree is built on the standard library's tokenizer with the parts of HTML5
tree building that matter to text: void elements, raw text of scripts and styles,
implied ends of p, li, option, table parts and headings' siblings, first of
repeated attributes.  A walk visits each node once.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

VOID = frozenset("area base br col embed frame hr img input isindex link meta param source track wbr keygen import".split())
BLOCK = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
_CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select", "datalist", "optgroup")),
    "optgroup": (("option", "optgroup"), ("select",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tr", "td", "th", "tbody", "thead", "tfoot"), ("table",)),
    "thead": (("tr", "td", "th", "tbody", "thead", "tfoot"), ("table",)),
    "tfoot": (("tr", "td", "th", "tbody", "thead", "tfoot"), ("table",)),
}
HEADS = frozenset("title meta link base style script noscript template".split())


class Node:
    __slots__ = ("tag", "attrs", "kids", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.kids, self.parent = tag, attrs, [], parent

    def walk(self):
        """Elements under this one, in document order."""
        todo = [self]
        while todo:
            x = todo.pop()
            if x is not self:
                yield x
            todo.extend(k for k in reversed(x.kids) if not isinstance(k, str))

    def up(self):
        x = self.parent
        while x is not None:
            yield x
            x = x.parent

    def raw_text(self) -> str:
        return "".join(k if isinstance(k, str) else k.raw_text() for k in self.kids)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", {}, None)
        self.at = self.root

    def handle_starttag(self, tag, attrs):
        if tag in _CLOSES:
            ends, within = _CLOSES[tag]
            x, hit = self.at, None
            while x.tag not in within and x is not self.root:
                if x.tag in ends:
                    hit = x
                x = x.parent
            if hit is not None:
                self.at = hit.parent
        elif tag in BLOCK:
            x = self.at
            while x is not self.root and x.tag not in ("td", "th", "button", "object", "caption", "body"):
                if x.tag == "p":
                    self.at = x.parent
                    break
                x = x.parent
        elif tag == "body" or tag not in HEADS:
            x = self.at
            while x is not self.root:
                if x.tag == "head":
                    self.at = x.parent
                    break
                x = x.parent
        first: dict[str, str] = {}
        for k, v in attrs:
            first.setdefault(k, v or "")
        n = Node(tag, first, self.at)
        self.at.kids.append(n)
        if tag not in VOID:
            self.at = n

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        x = self.at
        while x is not self.root:
            if x.tag == tag:
                self.at = x.parent
                return
            x = x.parent

    def handle_data(self, data):
        self.at.kids.append(data)


def parse(body: str) -> Node:
    b = _Builder()
    b.feed(body)
    b.close()
    return b.root


# Elements and attributes that hold addresses, in output order: (element, attribute, reported tag, reported attribute, element it must be in).
RULES = [
    ("a", "href", "a", "href", ""), ("a", "ping", "a", "ping", ""), ("link", "href", "link", "href", ""), ("embed", "src", "embed", "src", ""),
    ("frame", "src", "frame", "src", ""), ("iframe", "src", "iframe", "src", ""), ("input", "src", "input-image", "src", ""), ("isindex", "action", "isindex", "action", ""),
    ("script", "src", "script", "src", ""), ("body", "background", "body", "background", ""), ("applet", "archive", "applet", "archive", ""), ("applet", "codebase", "applet", "codebase", ""),
    ("blockquote", "cite", "blockquote", "cite", ""), ("area", "ping", "area", "ping", ""), ("base", "href", "base", "href", ""), ("import", "implementation", "import", "implementation", ""),
    ("button", "formaction", "button", "formaction", ""), ("html", "manifest", "html", "manifest", ""), ("table", "background", "table", "background", ""),
    ("video", "src", "video", "src", ""), ("video", "poster", "video", "poster", ""), ("audio", "src", "audio", "src", ""),
    ("object", "data", "src", "data", ""), ("object", "codebase", "src", "codebase", ""), ("param", "value", "src", "value", "object"),
]
_by_tag: dict[str, list[tuple[int, str, str]]] = {}
for _n, (_e, _a, _t, _o, _in) in enumerate(RULES):
    _by_tag.setdefault(_e, []).append((_n, _a, _in))
HTMX = [("hx-get", "GET"), ("hx-post", "POST"), ("hx-put", "PUT"), ("hx-patch", "PATCH")]
_first = re.compile(r"^\s*(\S+)")


def _candidates(srcset: str) -> list[str]:
    return [m.group(1) for x in srcset.split(",") if (m := _first.match(x))]


_doctype = re.compile(r"""(?is)<!doctype[^>]*?system\s*(["'])([^>]*?)\1""")


def doctype_system(body: str) -> str:
    """Address of a SYSTEM doctype in the first 2048 characters; empty for none."""
    m = _doctype.search(body[:2048])
    return m.group(2) if m else ""


def links(root: Node, scripts: bool = False, jsluice: bool = False) -> list[tuple[str, str, str, str]]:
    """(tag, attribute, method, raw address) in output order, before the validity filter."""
    from ..operators.extract import SCRIPT_ENDPOINT

    found = _script_pattern(SCRIPT_ENDPOINT)
    simple: list[list[str]] = [[] for _ in RULES]
    images, sets, docs, metas, inline, deep = [], [], [], [], [], []
    htmx: dict[str, list[str]] = {a: [] for a, _ in HTMX}
    for n in root.walk():
        a = n.attrs
        for rule, attr, inside in _by_tag.get(n.tag, ()):
            if attr in a and (n.tag != "input" or a.get("type", "").lower() == "image") and (not inside or any(u.tag == inside for u in n.up())):
                simple[rule].append(a[attr])
        if n.tag == "img":
            for attr in ("dynsrc", "longdesc", "lowsrc"):
                if a.get(attr):
                    images.append(("img", attr, "GET", a[attr]))
            src = a.get("src", "")
            if src and src != "#" and not src.startswith("data:"):
                images.append(("img", "src", "GET", src))
            images += [("img", "srcset", "GET", u) for u in _candidates(a.get("srcset", ""))]
        elif n.tag == "source" and "srcset" in a and any(u.tag == "audio" for u in n.up()):
            sets += [("audio", "sourcesrcset", "GET", u) for u in _candidates(a["srcset"])]
        elif n.tag == "iframe" and "srcdoc" in a:
            docs += [("iframe", "srcdoc", "GET", u) for u in found(a["srcdoc"])]
        elif n.tag == "meta" and "content" in a:
            metas += [("meta", "refresh", "GET", u) for u in found(a["content"])]
        elif n.tag == "script" and (scripts or jsluice):
            here = found(n.raw_text())
            inline += [("script", "text", "GET", u) for u in here if scripts]
            deep += [("script", "jsluice-url", "GET", u) for u in here if jsluice]
        for attr, _ in HTMX:
            if a.get(attr):
                htmx[attr].append(a[attr])
    out = [(RULES[i][2], RULES[i][3], "GET", v) for i, vs in enumerate(simple) for v in vs]
    out += images + sets + docs + metas
    out += [("htmx", attr, m, v) for attr, m in HTMX for v in htmx[attr]]
    return out + inline + deep


def _script_pattern(pattern: str):
    p = re.compile(pattern)

    def run(text: str) -> list[str]:
        return list(dict.fromkeys(m.group(1) for m in p.finditer(text)))

    return run


def valid(raw: str) -> bool:
    t = raw.strip().lower()
    return bool(t) and not t.startswith(("data:", "mailto:", "javascript:", "vbscript:"))


def forms(root: Node) -> list[tuple[str, str, str, list[str]]]:
    """(method, action, enctype, names of fields) of each form."""
    out = []
    for f in root.walk():
        if f.tag == "form":
            names = [n.attrs["name"] for n in f.walk() if n.tag in ("input", "select", "textarea") and n.attrs.get("name")]
            out.append((f.attrs.get("method", "GET").upper(), f.attrs.get("action", ""), f.attrs.get("enctype", "application/x-www-form-urlencoded"), names))
    return out


# What forms are filled with.
FILL = {"email": "crawler@example.com", "color": "#e66465", "password": "crawlerP@ssw0rd1", "placeholder": "crawler"}


def _number(a: dict[str, str], name: str, default: int) -> int:
    try:
        return int(a[name])
    except (KeyError, ValueError):
        return default


def _filled(n: Node, had: dict[str, str], fill: dict[str, str]) -> str | None:
    """Value for a field; None leaves what is there."""
    a = n.attrs
    if n.tag == "textarea":
        return fill["placeholder"]
    if n.tag == "select":
        options = [o for o in n.walk() if o.tag == "option"]
        pick = next((o for o in options if "selected" in o.attrs), options[0] if options else None)
        return pick.attrs.get("value", "") if pick is not None else None
    kind = a.get("type", "text").lower()
    if kind == "radio":
        return None if a.get("name", "") in had else a.get("value", "")
    if kind == "checkbox":
        return a.get("value", "")
    given = a.get("value") or a.get("placeholder")
    if given:
        return given
    if kind in ("number", "range"):
        low, high, step = _number(a, "min", 1), _number(a, "max", 10), _number(a, "step", 1)
        return str(low + step if low + step <= high else high - step)
    return fill["email" if kind == "email" else "color" if kind == "color" else "password" if kind in ("password", "tel") else "placeholder"]


def suggestions(form: Node, fill: dict[str, str] = FILL) -> dict[str, str]:
    """Names and values of a form's fields, first place and last value of a name."""
    out: dict[str, str] = {}
    for n in form.walk():
        if n.tag in ("input", "select", "textarea"):
            v = _filled(n, out, fill)
            if v is not None and n.attrs.get("name"):
                out[n.attrs["name"]] = v
    return out


def quote_component(s: str) -> str:
    return "".join(c if c.isascii() and c.isalnum() else "".join(f"%{b:02X}" for b in c.encode()) for c in s)


def filled_requests(root: Node, fill: dict[str, str] = FILL) -> list[tuple[str, str, str, str]]:
    """(method, action, body, enctype) of each form filled in; GET puts the fields into the address."""
    out = []
    for f in root.walk():
        if f.tag != "form":
            continue
        fields = suggestions(f, fill)
        if not fields:
            continue
        method, action = f.attrs.get("method", "GET").upper(), f.attrs.get("action", "")
        text = "&".join(f"{k}={quote_component(v)}" for k, v in fields.items())
        if method == "GET":
            out.append((method, action + ("&" if "?" in action else "?") + text, "", ""))
        else:
            out.append((method, action, text if method == "POST" else "", f.attrs.get("enctype", "application/x-www-form-urlencoded") if method == "POST" else ""))
    return out


_SILENT = frozenset(("script", "style", "noscript"))
_HIDDEN = frozenset(("script", "style", "head", "noscript", "template"))
_PARTS = frozenset("h1 h2 h3 p li div section article table tr form blockquote pre".split())
_SPAN_PARENTS = frozenset("div p td th li h1 h2 h3 blockquote".split())


def _words(n: Node) -> str:
    out: list[str] = []
    todo: list = [n]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif x is n or x.tag not in _SILENT:
            todo.extend(reversed(x.kids))
    return " ".join(" ".join(out).split())


def title(root: Node) -> str:
    return next((t for n in root.walk() if n.tag == "title" and (t := n.raw_text().strip())), "") or "Untitled Page"


#: Shapes of the blocks of the Markdown form.
SHAPES = {"h1": "\n# {}\n", "h2": "\n## {}\n", "h3": "\n### {}\n", "li": "* {}\n", "pre": "\n```\n{}\n```\n", "code": " `{}` ", **dict.fromkeys(("div", "span", "p", "td", "th", "blockquote"), "{}\n\n")}


def markdown(root: Node) -> str:
    """The page as Markdown blocks; a block that repeats the one before is left out."""
    out: list[str] = []
    last = ""
    todo = [(root, False)]
    while todo:
        n, hidden = todo.pop()
        hidden = hidden or n.tag in _HIDDEN
        if hidden:
            continue
        tag, a = n.tag, n.attrs
        if tag == "img":
            if a.get("src"):
                out.append(f"\n![{a.get('alt', 'Thumbnail')}]({a['src']})\n")
        elif tag == "a":
            t, href = _words(n), a.get("href")
            if t and href is not None and not href.startswith(("#", "javascript:")):
                out.append(f"[{t}]({href})\n")
        elif tag in SHAPES:
            skip = tag == "code" and n.parent.tag == "pre" or tag == "span" and n.parent.tag in _SPAN_PARENTS or tag == "div" and any(k.tag in _PARTS for k in n.walk())
            if not skip:
                t = _words(n)
                if t and t != last:
                    out.append(SHAPES[tag].replace("{}", t, 1))
                    last = t
        todo.extend((k, hidden) for k in reversed(n.kids) if not isinstance(k, str))
    return "".join(out)
