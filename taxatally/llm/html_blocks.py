"""A page as blocks of text, each with what its markup says about it."""

from __future__ import annotations

import re
from html import unescape

#: What a block is by its markup: nothing said, inside an article, marked as something else, not shown.
OPEN, ARTICLE, MARKED, HIDDEN = range(4)

_TAG = re.compile(r"""<(?:!--.*?(?:--!?>|\Z)|(/?)([a-zA-Z][^\s/>]*)([^>"']*+(?:(?:"[^"]*"|'[^']*')[^>"']*+)*+|[^>]*+)>|[!?/][^>]*(?:>|\Z))""", re.S)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]).*?(?:>|\Z)|\Z", re.I | re.S) for name in ("script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp")}
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup "
    "hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_NOT_SHOWN = frozenset("head noscript template svg math select datalist button object video audio canvas applet".split())
_CHROME = frozenset("nav footer aside form menu dialog search".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Parts of class and id names of what isn't main text.
_CHROME_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored banner promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter "
    "subscribe subscription signup login sidebar sidenav menu menus nav navbar navigation breadcrumb breadcrumbs topbar toolbar masthead comment comments disqus respond replies "
    "reply related recommended share sharing social widget widgets pagination pager".split()
)
_COMMENT_WORDS = frozenset("comment comments disqus reply replies".split())
#: A class that says what is beside it, as in ``has-sidebar``, doesn't mark the element itself.
_BESIDE = frozenset("has with without no".split())
_WALLS = frozenset("article main nav aside footer header section td th table form body".split())
#: Elements whose start ends an open one of those named.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "body": ("head",)}
_LISTS = {"li": frozenset(("ul", "ol", "menu")), "dt": frozenset(("dl",)), "dd": frozenset(("dl",)), "tr": frozenset(("table",)), "td": frozenset(("table", "tr")), "th": frozenset(("table", "tr"))}


def _own_kind(name: str, attributes: str, around: int) -> int:
    """What an element says of itself; ``around`` is what stands around it."""
    if name in _NOT_SHOWN:
        return HIDDEN
    kind = OPEN
    if name in _CHROME or name == "header" and around != ARTICLE:
        kind = MARKED
    elif name in ("article", "main"):
        kind = ARTICLE
    if attributes.strip(" /") and name not in ("html", "body"):
        for key, *values in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), "".join(values)
            if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return HIDDEN
            if name not in _BLOCK:
                continue
            if key == "role":
                role = value.strip().lower()
                kind = MARKED if role in _ROLES else max(kind, ARTICLE) if role in ("main", "article") else kind
            elif key in ("class", "id"):
                for token in value.split():
                    words = [w.lower() for w in _NAME_WORD.findall(token)]
                    if not words or words[0] in _BESIDE:
                        continue
                    marks = _COMMENT_WORDS if name in ("article", "main") else _CHROME_WORDS
                    if not marks.isdisjoint(words) or around != ARTICLE and name not in ("article", "main") and words[-1] in ("header", "footer"):
                        kind = MARKED
    return kind


def blocks(html: str | None) -> list[tuple[int, str, str]]:
    """``(kind, tag, text)`` of the blocks of a page that hold text, hidden ones left out.

    Block elements part blocks; other elements don't, and ``br`` is white space. Scripts, styles,
    comments and the like are gone, character references are read, white space is one space. Ends that
    are missing are taken as HTML does: at the next block, or with the element around.
    """
    out: list[tuple[int, str, str]] = []
    stack: list[tuple[str, int]] = []
    held: list[str] = []
    kind, tag = OPEN, "body"
    shown = OPEN  # kind of the text held

    def flush() -> None:
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            out.append((shown, tag, text))

    def hold(text: str) -> None:
        nonlocal shown
        if kind != HIDDEN:
            if kind != shown:
                flush()
                shown = kind
            held.append(text)

    def drop(names: tuple[str, ...], until: frozenset[str]) -> None:
        """End the innermost open element of ``names``, and all in it, unless one of ``until`` is between."""
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                del stack[i:]
                return
            if stack[i][0] in until:
                return

    html, at = html or "", 0
    while at < len(html):
        found = _TAG.search(html, at)
        text = html[at : found.start() if found else len(html)]
        if text:
            hold(unescape(text))
        if not found:
            break
        at = found.end()
        if found[2] is None:
            continue
        name = found[2].lower()
        if found[1]:
            if name in _BLOCK:
                flush()
            drop((name,), frozenset() if name in _WALLS else _WALLS)
        elif name in _RAW_END:
            end = _RAW_END[name].search(html, at)
            at = end.end()
            continue
        else:
            if name == "br":
                hold(" ")
            if name in _BLOCK:
                flush()
                if stack:
                    drop(("p",), _WALLS)
                    if name in _ENDS:
                        drop(_ENDS[name], _LISTS.get(name, frozenset()))
            if name not in _VOID:
                around = stack[-1][1] if stack else OPEN
                own = _own_kind(name, found[3], around)
                if name in _BLOCK or own != OPEN:
                    stack.append((name, own if name == "main" and around != HIDDEN else max(own, around)))
        kind = stack[-1][1] if stack else OPEN
        if name in _BLOCK:
            tag = stack[-1][0] if stack else "body"
    flush()
    return out
