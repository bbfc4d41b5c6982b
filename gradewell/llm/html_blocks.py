"""HTML -> the sequence of its leaf blocks, with tag paths."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

#: Markup in one pass: comments, scripts and styles, declarations, tags with quoted attributes, other tags.
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style)\b[^>]*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<[!?][^>]*+>?"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>(?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+)>"
    r"|</?[a-zA-Z][^>]*+>",
    re.DOTALL | re.IGNORECASE,
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
_PARTS = re.compile(r"[A-Za-z][a-z]+|[A-Z]+(?![a-z])|[a-z]+")

#: Elements that begin and end a block (those with fallback text among them), in alphabetical order.
BLOCK_TAGS = (
    "address article aside audio blockquote body button canvas caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html iframe label legend li main menu nav noscript object ol option p pre search section select summary "
    "svg table tbody td template textarea tfoot th thead title tr ul video"
).split()
_BLOCK = frozenset(BLOCK_TAGS)
#: An opening tag of the first kind closes an open one of the second kind, up to the given scope.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, set()),
}
_IN_PARAGRAPH = frozenset("button label option select textarea".split())
_VOID = frozenset({"hr"})


@dataclass
class Block:
    text: str
    path: tuple[tuple[str, tuple[str, ...]], ...]  # tag and name parts of each open block element
    linked: int  # characters inside links


def _name_parts(attrs: str) -> tuple[str, ...]:
    out = []
    for m in _NAMES.finditer(attrs):
        out += [p.lower() for p in _PARTS.findall(m[1] or m[2] or m[3] or "")]
    return tuple(out)


def blocks(source: str | None) -> list[Block]:
    """Leaf blocks in page order; white space inside a block is one space, empty blocks are left out."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked = in_link = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, tuple(stack), linked))
            parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        parts.append(text)
        if in_link:
            linked += len(text)

    source, at = source or "", 0
    for m in _MARKUP.finditer(source):
        if m.start() > at:
            add(source[at : m.start()])
        at = m.end()
        if m["tag"] is None:
            continue
        tag, closing = m["tag"].lower(), bool(m["end"])
        if tag == "a":
            in_link = 0 if closing else 1
        elif tag == "br":
            add(" ")
        elif tag in _BLOCK:
            flush()
            if closing:
                if any(t == tag for t, _ in stack):
                    while stack.pop()[0] != tag:
                        pass
                    in_link = 0
            elif tag not in _VOID:
                if tag not in _IN_PARAGRAPH and stack and stack[-1][0] == "p":
                    stack.pop()
                closes, scope = _CLOSES.get(tag, (None, None))
                if closes:
                    k = len(stack) - 1
                    while k >= 0 and stack[k][0] not in closes and stack[k][0] not in scope:
                        k -= 1
                    if k >= 0 and stack[k][0] in closes:
                        del stack[k:]
                stack.append((tag, _name_parts(m["attrs"]) if m["attrs"] else ()))
    if at < len(source):
        add(source[at:])
    flush()
    return out
