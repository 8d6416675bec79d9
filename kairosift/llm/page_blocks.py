"""Pages as sequences of leaf blocks: the text of an element without its block children, with the elements around it.

A scan from tag to tag, with a stack of open block elements; elements that no reader sees (scripts, styles, titles, ...)
are left out with their content. Work is linear in the page: what an element adds to a path is joined to its parent's
tokens once, and an element that is never closed is searched for once.
"""

from __future__ import annotations

import html
import re
import zlib
from typing import NamedTuple

#: Elements that break the text, so what is in them is a block of its own.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li "
    "main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose content isn't text of the page.
UNSEEN = frozenset("script style title noscript template iframe svg math canvas object select textarea audio video".split())
#: A start tag closes the open elements of its group, up to the element that holds them.
ENDS = {t: (group, holders) for group, holders in (
    (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])), (frozenset(["dt", "dd"]), frozenset(["dl"])), (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    (frozenset(["tr"]), frozenset(["table", "tbody", "thead", "tfoot"])), (frozenset(["option"]), frozenset(["optgroup"])),
) for t in group}
_NOTHING = (frozenset(), frozenset())

_TAG = re.compile(
    r"<!--.*?(?:-->|$)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/<>]*+)(?P<rest>(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+'){0,400}+)>|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/<>]*+)(?P<rest2>[^<>]*+)>|<[!?/][^>]*+(?:>|$)",
    re.S,
)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

#: Rows of the tables of path tokens and of words.
PATHS, WORDS = 2048, 4096


class Block(NamedTuple):
    text: str
    path: frozenset[int]  # numbers of the tokens of all elements around it
    own: int  # of the innermost element's name
    links: float  # share of its characters that are in links


def number(token: str, size: int) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) % size


def _tokens(name: str, rest: str) -> frozenset[int]:
    out = {number("e:" + name, PATHS)}
    if rest:
        for given in _NAMES.findall(rest):
            out.update(number("n:" + part.lower(), PATHS) for part in _PARTS.findall("".join(given)))
    return frozenset(out)


class _Known(dict):
    """Tokens of the start tags met, kept up to a bound."""

    def __missing__(self, key: tuple[str, str]) -> frozenset[int]:
        if len(self) > 20_000:
            self.clear()
        got = self[key] = _tokens(*key)
        return got


_KNOWN = _Known()


def blocks(page: str | None) -> list[Block]:
    """The blocks of a page with any text, in page order."""
    if not page:
        return []
    out: list[Block] = []
    stack: list[tuple[str, frozenset[int]]] = [("", frozenset())]
    open_: dict[str, int] = {}
    pieces: list[str] = []
    linked = links = at = 0
    unclosed: set[str] = set()

    def text(piece: str) -> None:
        nonlocal linked
        if "&" in piece:
            piece = html.unescape(piece)
        pieces.append(piece)
        if links:
            linked += len(piece)

    def flush() -> None:
        nonlocal linked
        if pieces:
            whole = "".join(pieces)
            words = " ".join(whole.split())
            if words:
                name, path = stack[-1]
                out.append(Block(words, path, number("o:" + name, PATHS), min(1.0, linked / len(words))))
            pieces.clear()
        linked = 0

    def pop() -> None:
        name = stack.pop()[0]
        open_[name] -= 1

    while True:
        found = _TAG.search(page, at)
        if found is None:
            text(page[at:])
            break
        if found.start() > at:
            text(page[at : found.start()])
        at = found.end()
        name = found["name"] or found["name2"]
        if name is None:  # comments and declarations
            continue
        name, end = name.lower(), bool(found["end"] or found["end2"])
        if name in BLOCK:
            flush()
            if end:
                if open_.get(name):
                    while stack[-1][0] != name:
                        pop()
                    pop()
                continue
            links = 0
            if open_.get("p"):
                closing, holders = frozenset(["p"]), frozenset(["td", "th", "li", "div", "article", "section", "main", "aside", "blockquote", "form"])
                _close(stack, open_, closing, holders)
            _close(stack, open_, *ENDS.get(name, _NOTHING))
            if name != "hr":
                stack.append((name, stack[-1][1] | _KNOWN[name, found["rest"] or found["rest2"] or ""]))
                open_[name] = open_.get(name, 0) + 1
        elif name in UNSEEN:
            if not end and name not in unclosed and not (found["rest"] or "").endswith("/"):
                close = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)
                if close:
                    at = close.end()
                elif name in ("script", "style"):
                    break  # the rest of the page is its content
                else:
                    unclosed.add(name)
        elif name == "br":
            pieces.append(" ")
        elif name == "a":
            links = 0 if end else 1
    flush()
    return out


def _close(stack: list, open_: dict[str, int], closing: frozenset[str], holders: frozenset[str]) -> None:
    """Close the innermost open element of ``closing`` with what is in it, unless one of ``holders`` is nearer."""
    if not any(open_.get(n) for n in closing):
        return
    for depth in range(len(stack) - 1, 0, -1):
        name = stack[depth][0]
        if name in closing:
            while len(stack) > depth:
                open_[stack.pop()[0]] -= 1
            return
        if name in holders:
            return
