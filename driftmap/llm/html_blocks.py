"""Pages as sequences of leaf blocks: text between block-level tags, with the path of tags above it."""

from __future__ import annotations

import html
import re
from typing import NamedTuple

#: Tags that end a block of text (fixed values).
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html label legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags whose start ends an open tag of the same group, up to the container that holds the group (fixed values).
IMPLIED_ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select", "optgroup")),
}
#: Elements nested deeper are treated as siblings, as browsers do.
DEEPEST = 512

_ATTRIBUTES = r"(?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?+)*+"
_MARKUP = re.compile(
    r"<!--(?:.*?-->|.*\Z)"
    rf"|<(script|style|noscript|template|title|iframe|svg|math|object|noframes|xmp)(?=[\s/>]){_ATTRIBUTES}>(?:.*?</\1(?=[\s/>])[^>]*+(?:>|\Z)|.*\Z)"
    rf"|<(/?)([a-z][^\s/>]*+)({_ATTRIBUTES})(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.S | re.I,
)
_NAMES = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)|'([^']*)|([^\s>]+))", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


class Block(NamedTuple):
    text: str
    path: int
    linked: int


class Page(NamedTuple):
    """Blocks in page order, and the tokens of each distinct path: names of tags, classes, ids and roles, nearest ones also by their distance."""

    blocks: list[Block]
    paths: list[tuple[str, ...]]


def _tokens(tag: str, attributes: str) -> tuple[str, ...]:
    found = [tag]
    for names in _NAMES.findall(attributes):
        found += ["." + x.lower() for x in _PART.findall(" ".join(names))]
    return tuple(found)


def parse(source: str) -> Page:
    """The blocks of a page that have text. Character references are decoded and white space becomes one space."""
    blocks: list[Block] = []
    known: dict[tuple[int, tuple[str, ...]], int] = {}
    levels: list[tuple[tuple[str, ...], ...]] = [()]
    stack: list[tuple[str, int]] = []
    pieces: list[str] = []
    linked = links = 0
    is_open: dict[str, int] = {}

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                blocks.append(Block(text, stack[-1][1] if stack else 0, min(linked, len(text))))
            pieces.clear()
            linked = 0

    def close(tag: str) -> None:
        while stack:
            gone = stack.pop()[0]
            is_open[gone] -= 1
            if gone == tag:
                return

    def add(piece: str) -> None:
        nonlocal linked
        if piece:
            piece = html.unescape(piece) if "&" in piece else piece
            pieces.append(piece)
            if links:
                linked += len(piece.strip())

    end = 0
    for m in _MARKUP.finditer(source):
        add(source[end : m.start()])
        end = m.end()
        tag = m[3]
        if not tag:
            if m[1] and m[1].lower() not in ("svg", "math", "object", "iframe"):
                flush()
            continue
        tag = tag.lower()
        if tag not in BLOCK_TAGS:
            if tag == "a":
                links = 0 if m[2] else 1
            elif tag == "br":
                pieces.append(" ")
            continue
        flush()
        if m[2]:
            if is_open.get(tag):
                close(tag)
            continue
        if is_open.get("p"):
            close("p")
        group, inside = IMPLIED_ENDS.get(tag, ((), ()))
        if any(is_open.get(t) for t in group):
            for t, _ in reversed(stack):
                if t in inside:
                    break
                if t in group:
                    close(t)
                    if tag != "tr":
                        break
        if tag in VOID_TAGS:
            continue
        if len(stack) >= DEEPEST:
            is_open[stack.pop()[0]] -= 1
        key = (stack[-1][1] if stack else 0, _tokens(tag, m[4]))
        if key not in known:
            known[key] = len(levels)
            levels.append((*levels[key[0]], key[1]))
        stack.append((tag, known[key]))
        is_open[tag] = is_open.get(tag, 0) + 1
    add(source[end:])
    flush()
    used = sorted({b.path for b in blocks})
    place = {p: i for i, p in enumerate(used)}
    return Page([b._replace(path=place[b.path]) for b in blocks], [_path_tokens(levels[p]) for p in used])


def _path_tokens(levels: tuple[tuple[str, ...], ...]) -> tuple[str, ...]:
    near = [f"{t}^{i}" for i, level in enumerate(reversed(levels[-3:])) for t in level]
    return (*dict.fromkeys(t for level in levels for t in level), *near) or ("none",)
