"""HTML pages to leaf blocks: runs of text between the starts and ends of block elements, with the path of open tags."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

_TAG = re.compile(r"""<!--(?:.*?-->|.*\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*)(?:>|\Z)""", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)

#: Elements whose content is never text, that have no content, and that begin and end blocks. Fixed values.
UNSEEN = frozenset("script style noscript template textarea title svg iframe object audio video canvas select math".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p
pre search section summary table tbody td tfoot th thead tr ul""".split())
#: What a start tag ends by itself, if it is the nearest of its kind.
CLOSES = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_KEEPS_P, _P, _NOTHING = BLOCK - {"button", "option", "caption"}, frozenset("p"), frozenset()


class Element:
    """An open element: its name with its class, id and role words, and the element around it."""

    __slots__ = ("name", "words", "parent", "vector")

    def __init__(self, name: str, words: tuple[str, ...], parent: Element | None):
        self.name, self.words, self.parent, self.vector = name, words, parent, None

    def path(self, depth: int) -> Iterator[Element]:
        """This element and those around it, ``depth`` of them at most."""
        at: Element | None = self
        while at is not None and depth:
            yield at
            at, depth = at.parent, depth - 1


@dataclass
class Block:
    text: str
    inside: Element | None
    linked: int  # characters within links


def blocks(page: str) -> list[Block]:
    """All leaf blocks with any text, in page order. Unclosed and misplaced tags are taken as browsers roughly do.

    Time and memory grow with the page's length alone: paths are shared, and what closes nothing is known at once.
    """
    out: list[Block] = []
    stack: list[Element] = []
    block_at: list[int] = []  # places in the stack of the elements that make blocks
    opened: Counter[str] = Counter()
    pieces: list[str] = []
    linked = at = 0
    unclosed: set[str] = set()  # unseen elements that never end again
    end = len(page)

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(pieces).split())
        if text:
            out.append(Block(text, stack[-1] if stack else None, linked))
        pieces.clear()
        linked = 0

    def close(to: int) -> None:
        while len(stack) > to:
            opened[stack.pop().name] -= 1
        while block_at and block_at[-1] >= to:
            block_at.pop()

    while at < end:
        found = _TAG.search(page, at)
        raw = page[at : found.start()] if found else page[at:]
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            pieces.append(text)
            if opened["a"]:
                linked += len(text)
        if not found:
            break
        at = found.end()
        closing, name, rest = found.group(1, 2, 3) if found.group(2) else found.group(4, 5, 6)
        if not name:
            continue
        name = name.lower()
        if name in BLOCK:
            flush()
        if closing:
            if opened[name]:
                k = len(stack) - 1
                while stack[k].name != name:
                    k -= 1
                close(k)
            continue
        if name == "br":
            pieces.append(" ")
        if name in VOID:
            continue
        if name in UNSEEN:
            ended = None if name in unclosed else _ends(name).search(page, at)
            if not ended:
                unclosed.add(name)
            at = ended.end() if ended else end
            continue
        ends = CLOSES.get(name) or (_P if name in _KEEPS_P else _NOTHING)
        while block_at and stack[block_at[-1]].name in ends:
            close(block_at[-1])
        words = tuple(w.lower() for groups in _NAMES.findall(rest) for w in "".join(groups).split()) if "=" in rest else ()
        if name in BLOCK:
            block_at.append(len(stack))
        opened[name] += 1
        stack.append(Element(name, words, stack[-1] if stack else None))
    flush()
    return out


@cache
def _ends(name: str) -> re.Pattern:
    return re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I)
