"""Web pages as trees of block elements and runs of text."""

from __future__ import annotations

import re
from html import unescape

# --- fixed values: elements of HTML by their role ---
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "xmp")
FOREIGN = frozenset("svg math object template".split())
BOILERPLATE_TAGS = frozenset(
    "head nav footer aside form script style noscript template iframe svg math object button select textarea title dialog menu dir".split()
)
BOILERPLATE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense adbox banner banners sponsor sponsored promo promotion nav navbar navigation menu menus"
    " breadcrumb breadcrumbs sidebar sidebars aside footer masthead topbar toolbar comment comments commentlist disqus reply replies respond"
    " cookie cookies consent gdpr notice notices alert share sharing social related recommended newsletter subscribe subscription signup login"
    " popup modal overlay pagination pager widget widgets skip skiplink copyright".split()
)
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# an opening tag on the left ends an open element on the right
ENDS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "thead": ("tbody",), "tbody": ("thead", "tbody"), "tfoot": ("tbody", "thead"),
}
# such an element keeps an opening tag from ending elements outside of it
SCOPES = frozenset("table ul ol dl td th body html article section main div aside nav header footer".split())

# Elements below this depth dissolve into their ancestor, but for boilerplate.
DEEPEST = 120

_ATTRIBUTES = r"""(?:[^>"']|"[^"]*"|'[^']*')*"""
_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<(?P<raw>" + "|".join(RAW) + rf")(?=[\s/>])(?P<rawattr>{_ATTRIBUTES})>(?P<content>.*?)(?:</(?P=raw)(?=[\s/>])[^>]*>|$)"
    rf"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attr>{_ATTRIBUTES})>|<[!?/][^>]*>|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_WORD = re.compile(r"[a-z]+")


class Node:
    """A block element (key, children) or a run of text (key "#", text, characters in links)."""

    __slots__ = ("children", "key", "linked", "text")

    def __init__(self, key: str, text: str = "", linked: int = 0):
        self.key, self.text, self.linked = key, text, linked
        self.children: list[Node] = []


def _describe(tag: str, attributes: str) -> tuple[str, bool]:
    """Key of an element (its name and the words of class and id), and whether it is boilerplate."""
    dropped, words = tag in BOILERPLATE_TAGS, []
    if attributes:
        for name, *values in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), "".join(values).lower()
            if name in ("class", "id"):
                words += _WORD.findall(value)
            elif name == "role":
                dropped |= value in BOILERPLATE_ROLES
                words.append("=" + value)
            elif name == "hidden" or (name == "aria-hidden" and value == "true"):
                dropped = True
    dropped |= not BOILERPLATE_WORDS.isdisjoint(words) and tag not in ("html", "body", "article", "main")
    return f"{tag}.{'.'.join(dict.fromkeys(words))}" + "!" * dropped, dropped


def parse(html: str) -> Node:
    """The page's tree. Inline elements dissolve into the text around them; their marks
    and comments leave no gap. A line break is white space. Unclosed elements end where
    HTML ends them, stray closing tags are ignored. Text is decoded, its white space
    single, and runs of white space alone are left out. Raw content (scripts, styles
    and the like) is not kept, nor are drawings, formulas, objects and templates, which end with
    their parent where they are not closed. Depth is bounded."""
    root = Node("root")
    open_nodes: list[tuple[str, Node]] = [("root", root)]
    inline: list[str] = []  # open inline elements of the current run
    pieces: list[str] = []
    linked: list[str] = []
    foreign: list[str] = []  # open elements from a drawing or the like on

    def flush() -> None:
        if pieces:
            text = " ".join(unescape("".join(pieces)).split())
            if text:
                open_nodes[-1][1].children.append(Node("#", text, len(" ".join(unescape("".join(linked)).split()))))
            pieces.clear()
            linked.clear()

    def pop(at: int) -> None:
        flush()
        del open_nodes[at:]

    at_char = 0
    while (token := _TOKEN.match(html, at_char)) is not None:
        at_char = token.end()
        text = token["text"]
        if foreign:
            if token["raw"] is not None and token["rawattr"].endswith("/"):
                at_char = token.start("content")  # as in XML
            if token["tag"] is None:
                continue
            tag = token["tag"].lower()
            if not token["close"]:
                if tag not in VOID and not token["attr"].endswith("/"):
                    foreign.append(tag)
                continue
            if tag in foreign:
                del foreign[len(foreign) - 1 - foreign[::-1].index(tag) :]
                continue
            if tag not in inline and not any(name == tag for name, _ in open_nodes):
                continue
            foreign.clear()
        if text is not None:
            pieces.append(text)
            if "a" in inline:
                linked.append(text)
            continue
        if token["raw"] is not None:
            continue
        if token["tag"] is None:
            continue
        tag = token["tag"].lower()
        if tag == "br":
            pieces.append(" ")
            continue
        if token["close"]:
            if tag in INLINE and not any(name == tag for name, _ in open_nodes):
                if tag in inline:
                    inline.remove(tag)
                continue
            for at in range(len(open_nodes) - 1, 0, -1):
                if open_nodes[at][0] == tag:
                    pop(at)
                    break
            continue
        if tag in FOREIGN:
            if not token["attr"].endswith("/") or tag in ("object", "template"):
                foreign.append(tag)
            continue
        key, dropped = _describe(tag, token["attr"])
        if tag in INLINE and not dropped:
            if tag not in VOID:
                inline.append(tag)
            continue
        flush()
        for at in range(len(open_nodes) - 1, 0, -1):
            name = open_nodes[at][0]
            if name in ENDS.get(tag, ()) or (name == "p" and tag not in INLINE):
                pop(at)
                inline.clear()
                break
            if name in SCOPES:
                break
        node = open_nodes[-1][1]
        if len(open_nodes) < DEEPEST or (dropped and not node.key.endswith("!")):
            node = Node(key)
            open_nodes[-1][1].children.append(node)
        if tag not in VOID and not token["attr"].endswith("/"):
            open_nodes.append((tag, node))
    flush()
    return root
