"""Token sequences of raw HTML pages: structural tags with their paths, and blocks of text.

Only block-level elements are structural: inline tags neither end a block nor
stand in a path. Optional end tags (p, li, table parts, ...) are supplied, so
every start has its end. A block is the text between two structural tags or
line breaks, with character references decoded and white space collapsed.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import xxhash

_TAG = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))"""                                                        # comment
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*+(?:>|\Z))"""         # tag
    r"""|<[!?/][^>]*+(?:>|\Z)""", re.S)                                                       # declaration
_ATTR = re.compile(r"""(?<![^\s"'])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# fixed values: element names of HTML
BLOCK = frozenset(
    "address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav "
    "noscript object ol optgroup option p pre search section select summary table tbody td template textarea tfoot "
    "th thead title tr ul iframe svg math canvas audio video button script style".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
#: A start tag of the key ends an open element of the values.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
        "th": {"td", "th"}, "option": {"option"}, "optgroup": {"option", "optgroup"},
        "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody", "thead"}, "body": {"head"}}
#: Elements beyond which an optional end doesn't reach.
WALLS = frozenset("ul ol table dl select article section div nav aside body html menu".split())
MAIN = frozenset(("article", "main"))
#: Elements whose text is no part of an article.
JUNK = frozenset(
    "aside audio button canvas datalist dialog fieldset footer form head iframe math menu nav noscript object option "
    "search select script style svg template textarea title video".split())
JUNK_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search "
                       "tablist toolbar".split())
#: Words of a class or id that name such a part; the second set only outside an article.
JUNK_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising breadcrumb breadcrumbs comment comments consent cookie cookies "
    "disqus menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted "
    "recommended related share sharing sidebar social sponsor sponsored subscribe subscription".split())
OUTER_WORDS = frozenset("banner footer header login masthead search toolbar widget".split())
#: Words of wrappers around an article, such as ``content with-sidebar``.
WRAP_WORDS = frozenset("article body container content has main page with without wrapper".split())


@dataclass
class Page:
    roles: list[int]         # tokens in order: tags by (path, start or end), blocks by (path, text)
    depths: list[int]        # length of the path after each token
    blocks: list[str]
    paths: list[str]         # of each block: signatures of the open elements, joined by >
    at: list[int]            # place of each block in ``roles``
    junk: list[bool]         # block lies in a menu, footer, form, ...
    main: bool = False       # the page has an article or main element


def _signed(data: str) -> int:
    x = xxhash.xxh3_64_intdigest(data.encode("utf-8", "surrogatepass"))
    return x - (1 << 64) if x >> 63 else x


_ROLES: dict[tuple[str, str], int] = {}


def role_of(kind: str, path: str) -> int:
    """Number of a structural token (``kind`` is ``<`` or ``>``)."""
    r = _ROLES.get((kind, path))
    if r is None:
        if len(_ROLES) > 200_000:  # a cache, no table: it starts again
            _ROLES.clear()
        r = _ROLES[kind, path] = _signed(f"{kind} {path}")
    return r


def _describe(tag: str, attrs: str, inside: bool) -> tuple[str, bool]:
    """(signature: the name, and class and id without digits; whether the element is no part of an article)."""
    found = {"class": "", "id": "", "role": ""}
    for m in _ATTR.finditer(attrs):
        name = m[1].lower()
        found[name] = found[name] or m[2] or m[3] or m[4] or ""
    sign = tag
    if found["class"] or found["id"]:
        names = sorted(found["class"].split()) + [f"#{x}" for x in found["id"].split()]
        sign += "." + ".".join(re.sub(r"[\d>]+", "", x) for x in names)
    if tag in MAIN or tag in ("html", "body"):
        return sign, False
    words = {w.lower() for w in _WORD.findall(f"{found['class']} {found['id']}")}
    junk = (tag in JUNK or (tag == "header" and not inside) or found["role"].lower() in JUNK_ROLES
            or (not words & WRAP_WORDS and (bool(words & JUNK_WORDS) or (not inside and bool(words & OUTER_WORDS)))))
    return sign, junk


def parse(source: str) -> Page:
    page = Page([], [], [], [], [], [])
    stack: list[tuple[str, str, bool]] = []  # tag, path up to it, no part of an article
    inside, text = 0, []
    pos, n = 0, len(source)

    def flush() -> None:
        if not text:
            return
        block = " ".join(html.unescape("".join(text)).split())
        text.clear()
        if block:
            path = stack[-1][1] if stack else ""
            page.at.append(len(page.roles))
            page.roles.append(_signed(f"{path}\n{block}"))
            page.depths.append(len(stack))
            page.blocks.append(block)
            page.paths.append(path)
            page.junk.append(bool(stack) and stack[-1][2])

    def close() -> None:
        nonlocal inside
        flush()
        tag, path, _ = stack.pop()
        inside -= tag in MAIN
        page.roles.append(role_of(">", path))
        page.depths.append(len(stack))

    while pos < n:
        m = _TAG.search(source, pos)
        if m is None:
            text.append(source[pos:])
            break
        if m.start() > pos:
            text.append(source[pos:m.start()])
        pos = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag not in BLOCK:
            if tag == "br":
                flush()
            if tag in RAW and not m[1]:
                pos = _past(source, pos, tag)
            continue
        if not m[3].endswith(">"):
            break  # cut off inside a tag
        if m[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    while len(stack) > i:
                        close()
                    break
            else:
                flush()
            continue
        flush()
        if tag in ("html", "body") and any(s[0] == tag for s in stack):
            continue
        ends = ENDS.get(tag, ())
        if stack and stack[-1][0] == "p":
            close()
        if ends:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in ends:
                    while len(stack) > i:
                        close()
                elif stack[i][0] in WALLS and not (tag == "body"):
                    break
        sign, junk = _describe(tag, m[3], inside > 0)
        path = f"{stack[-1][1]}>{sign}" if stack else sign
        junk = junk or (bool(stack) and stack[-1][2])
        if tag in VOID or (m[3].endswith("/>") and tag in ("svg", "math")):
            continue
        stack.append((tag, path, junk))
        inside += tag in MAIN
        page.main |= tag in MAIN
        page.roles.append(role_of("<", path))
        page.depths.append(len(stack))
        if tag in RAW:
            start, pos = pos, _past(source, pos, tag)
            if tag == "title":
                text.append(source[start:_begin(source, start, tag)])
            close()
    flush()
    while stack:
        close()
    return page


def _begin(source: str, pos: int, tag: str) -> int:
    """Where the end tag of a raw element begins (the end of the page, if it never ends)."""
    m = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(source, pos)
    return m.start() if m else len(source)


def _past(source: str, pos: int, tag: str) -> int:
    at = source.find(">", _begin(source, pos, tag))
    return len(source) if at < 0 else at + 1


def host_of(url: str | None) -> str:
    """The host of a URL, lower-cased, without user and port; empty if there is none."""
    m = re.match(r"\s*[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#\\]*)", url or "")
    return m[1].rpartition("@")[2].partition(":")[0].lower() if m else ""


__all__ = ["BLOCK", "JUNK", "MAIN", "Page", "host_of", "parse", "role_of"]
