"""Blocks of text in a page of HTML, each with the zone it stands in."""

from __future__ import annotations

import html
import re

PLAIN, CONTENT, CHROME = 0, 1, 2
#: Furniture by the words of a class or id alone: it does not reach into an article or main element, whatever its words.
HINTED = 3

#: Element names of the HTML standard.
BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("title script style noscript template textarea iframe object svg math canvas audio video select button".split())
CHROME_TAGS = set("nav aside footer form menu dialog head".split())
CHROME_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Words in a class or id that name page furniture.
CHROME_WORDS = set(
    "nav navbar navigation menu sidebar aside footer cookie cookies consent gdpr notice banner notification alert ad ads advert adverts advertisement advertising sponsor sponsored promo promotion "
    "popup modal newsletter subscribe subscription signup share sharing social comment comments disqus breadcrumb breadcrumbs related pagination pager widget login toolbar masthead".split())

#: Of these, the ones that name a place for other people's articles: an article in it stays furniture.
LISTING_WORDS = set("comment comments disqus related".split())
#: Words that make a class name a layout or a state ("no-sidebar", "ad-free") and not the thing it mentions.
STATE_WORDS = set("no not with without has is on off free open closed enabled disabled".split())
#: Class names that say an element holds the text.
TEXT_NAMES = set("content article main story entry post body text".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z](?:"[^"]*"|'[^']*'|[^'">])*>|</?[a-zA-Z][^>]*(?:>|\Z)|[^<]+|<""", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"""\s(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?(?=[\s/>])""", re.I)


def _named(value: str) -> list[set[str]]:
    """The words of every name in a class or id."""
    return [set(re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower())) - {""} for name in value.split()]


def _zone(name: str, tag: str, around: int) -> int:
    """Zone of an element, from its name, its attributes and the zone around it. Hidden elements, roles and element names decide;
    the words of a class or id are evidence that an article or main element, or a name for the text itself, outweighs."""
    if around == CHROME and name not in ("article", "main"):
        return CHROME
    names: list[set[str]] = []
    role, prop = "", ""
    if " " in tag or "\n" in tag or "\t" in tag:
        for key, value in _ATTRIBUTE.findall(tag):
            key, value = key.lower(), value.strip("\"'")
            if key in ("class", "id"):
                names += _named(value)
                continue
            value = value.lower()
            if key == "role":
                role = value
            elif key == "itemprop":
                prop = value
            elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return CHROME
    if name in ("html", "body"):
        return around
    words = set().union(*[n for n in names if not n & STATE_WORDS]) & CHROME_WORDS
    if name in ("article", "main"):
        listed = name == "article" and (around == CHROME or any(n <= LISTING_WORDS for n in names if n))
        return CHROME if role in CHROME_ROLES or listed else CONTENT
    if role in CHROME_ROLES or name in CHROME_TAGS or words & LISTING_WORDS:
        return CHROME
    if words and not any(n <= TEXT_NAMES for n in names if n):
        return HINTED
    if name == "header":
        return around if around == CONTENT else CHROME
    if role in ("main", "article") or prop == "articlebody":
        return CONTENT
    return around


def blocks(page: str | None) -> list[tuple[str, int]]:
    """(text, zone) of every non-empty block in page order: references decoded, white space turned into one space, trimmed."""
    out: list[tuple[str, int]] = []
    parts: list[str] = []
    stack: list[tuple[str, int]] = []
    zone = PLAIN
    skip = ""

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append((text, CHROME if zone == HINTED else zone))
            parts.clear()

    for token in _TOKEN.findall(page or ""):
        named = _NAME.match(token) if token[0] == "<" else None
        if named is None:
            if not skip and not token.startswith(("<!", "<?")):
                parts.append(token)
            continue
        name, closing = named[1].lower(), token[1] == "/"
        if skip:
            if closing and name == skip:
                skip = ""
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in BLOCKS:
            flush()
        if closing:
            if any(name == open_name for open_name, _ in stack):
                while stack:
                    open_name, around = stack.pop()
                    if zone != around:
                        flush()
                    zone = around
                    if open_name == name:
                        break
        elif name in RAW:
            if not token.endswith("/>"):
                skip = name
        elif name not in VOID:
            if name == "body" and zone in (CHROME, HINTED):  # a head that was never closed
                zone, stack = PLAIN, []
            inner = _zone(name, token, zone)
            if inner != zone:
                flush()
            stack.append((name, zone))
            zone = inner
    flush()
    return out
