"""A forgiving HTML reader: a tree of structural elements in page order, and blocks of text under them.

Inline elements aren't nodes: their text belongs to the nearest structural element, and links are counted. So do formulas
and drawings, with all their own elements, and what embedded media hold for readers that can't show them. Every start or
end of a structural element ends a block. Elements whose content a page doesn't show as text (scripts, styles, the head's
title, form controls, frames, inert templates) are skipped whole. Missing end tags are implied as HTML implies them.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

# Fixed values of HTML: elements without content, elements whose content isn't markup, inline elements, and what an end tag closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style title textarea template iframe select".split())
FOREIGN = frozenset("math svg".split())
INLINE = frozenset("a abbr acronym audio b bdi bdo big br canvas cite code data del dfn em font i img ins kbd label mark object q rp rt ruby s samp small span strike strong sub sup time tt u var video wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}, "option": {"option"}}
LIMITS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}}

#: These end a formula or drawing that wasn't closed.
BREAKS_OUT = CLOSES_P | frozenset(CLOSED_BY) | {"html", "body", "noscript"}

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>"']+|"[^"]*"|'[^']*')*+|[^>]*)>""", re.S)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|itemprop|rel|aria-label|hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@dataclass
class Page:
    """Nodes in page order. end: one past a node's last descendant. blocks: (node, text, characters of it in links, inside a form control)."""

    tag: list[str] = field(default_factory=list)
    tokens: list[tuple[str, ...]] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    links: list[int] = field(default_factory=list)
    controls: list[int] = field(default_factory=list)
    blocks: list[tuple[int, str, int]] = field(default_factory=list)


def attribute_tokens(raw: str) -> tuple[str, ...]:
    """Lower-case words of an element's class, id, role and the like."""
    found: list[str] = []
    for name, a, b, c in ATTRIBUTE.findall(raw):
        if name.lower() == "hidden":
            found.append("hidden")
        found += [w.lower() for w in WORD.findall(a or b or c)]
    return tuple(dict.fromkeys(found))


def read(source: str) -> Page:
    page = Page()
    page.tag.append("#root")
    for x in (page.tokens, page.links, page.controls, page.parent, page.depth, page.end):
        x.append(() if x is page.tokens else -1 if x is page.parent else 0)
    stack: list[tuple[str, int]] = [("#root", 0)]
    held: list[str] = []
    linked, in_link, foreign = 0, 0, 0

    def close_block() -> None:
        nonlocal linked
        if held:
            text = " ".join("".join(held).split())
            if text:
                page.blocks.append((stack[-1][1], text, linked))
            held.clear()
        linked = 0

    def pop() -> None:
        close_block()
        page.end[stack.pop()[1]] = len(page.tag)

    def add(piece: str) -> None:
        nonlocal linked
        if piece:
            piece = html.unescape(piece) if "&" in piece else piece
            held.append(piece)
            if in_link:
                linked += len(piece)

    at, n = 0, len(source)
    while at < n:
        found = TAG.search(source, at)
        if found is None:
            add(source[at:])
            break
        add(source[at : found.start()])
        at = found.end()
        if found[0].startswith("<![CDATA["):
            add(found[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        if found[2] is None:
            continue
        tag, closing = found[2].lower(), bool(found[1])
        if tag in SKIPPED:
            if not closing and not found[3].endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(source, at)
                at = end.end() if end else n if tag in ("script", "style", "textarea", "title") else at
            held.append(" ")
            continue
        if tag in FOREIGN:
            foreign = max(0, foreign - 1) if closing else foreign + (not found[3].endswith("/"))
            continue
        if foreign and tag not in BREAKS_OUT:
            held.append(" " if tag in ("text", "tspan", "desc", "mtext") else "")
            continue
        foreign = 0
        if tag in INLINE:
            if tag == "a":
                in_link = 0 if closing else 1
                page.links[stack[-1][1]] += not closing
            elif tag in ("br", "img", "wbr"):
                held.append(" " if tag == "br" else "")
            continue
        if tag in ("input", "button"):
            page.controls[stack[-1][1]] += not closing
        if tag in VOID:
            close_block()
            continue
        if closing:
            if any(name == tag for name, _ in stack):
                while stack[-1][0] != tag:
                    pop()
                pop()
            else:
                close_block()
            in_link = 0
            continue
        close_block()
        if tag in CLOSES_P and any(name == "p" for name, _ in stack):
            while stack[-1][0] != "p":
                pop()
            pop()
        elif tag in CLOSED_BY:
            while stack[-1][0] not in LIMITS[tag]:
                if stack[-1][0] in CLOSED_BY[tag]:
                    pop()
                elif any(name in CLOSED_BY[tag] for name, _ in stack[-3:]) and stack[-1][0] in ("p", "div"):
                    pop()
                else:
                    break
        if tag in ("html", "body") and any(name == tag for name, _ in stack):
            continue
        parent = stack[-1][1]
        page.tag.append(tag)
        page.tokens.append(attribute_tokens(found[3]) if found[3] else ())
        page.parent.append(parent)
        page.depth.append(page.depth[parent] + 1)
        page.end.append(0)
        page.links.append(0)
        page.controls.append(0)
        stack.append((tag, len(page.tag) - 1))
        if found[3].endswith("/") and tag not in CLOSES_P:
            pop()
    while stack:
        pop()
    return page
