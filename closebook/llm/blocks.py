"""Text blocks of a web page: a forgiving reader of markup.

A block is the text between two block-level tags; inline tags do not end it, `<br>` does.
Scripts, styles, comments, declarations and the document title hold no blocks. Open
elements stay open until something closes them; a tag that the page's end cuts off is
dropped. Character references are decoded, white space inside a block becomes one space.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from typing import NamedTuple

#: Fixed values of HTML: elements without content, without markup inside, and inline ones.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
#: Elements that an opening tag of the same group ends.
CLOSES = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dt": {"dt", "dd"},
          "dd": {"dt", "dd"}, "option": {"option"}}

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_NAMES = re.compile(r"(?:^|\s)(class|id|role|data-y)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPACE = re.compile(r"\s+")


#: Elements whose text is never the article's, and those it stands in, by their meaning in HTML.
AROUND = frozenset("nav header footer aside form button select dialog menu noscript".split())
MAIN = frozenset("article main".split())


class Element:
    """An open element: its tag and names (`tag`, `.class`, `#id`, `@role`), and what it inherits."""

    __slots__ = ("around", "label", "main", "names", "parent", "tag")

    def __init__(self, tag: str, names: tuple[str, ...], label: str | None, parent: Element | None):
        self.tag, self.names, self.parent = tag, names, parent
        self.label = label if label is not None or parent is None else parent.label
        said = any(n in AROUND or n[1:] in ("ad", "ads", "advert", "comments") for n in names)
        self.around = said or (parent is not None and parent.around)
        self.main = tag in MAIN or (parent is not None and parent.main)


class Block(NamedTuple):
    text: str
    place: Element | None  # innermost element around it that is not inline
    linked: int  # characters inside links
    label: str | None  # innermost data-y around it; only made-up training pages have it

    @property
    def main(self) -> bool:
        """Main text by the meaning of the elements around it."""
        return self.place is not None and self.place.main and not self.place.around

    @property
    def around(self) -> bool:
        """Not main text, by the meaning of an element around it."""
        return self.place is not None and self.place.around

    def names(self):
        """Names of the elements around, from the innermost outwards."""
        at = self.place
        while at is not None:
            yield from reversed(at.names)
            at = at.parent


def _opened(tag: str, attributes: str, parent: Element | None, outer: str | None) -> Element:
    names, label = [tag], outer
    if "=" in attributes:
        for m in _NAMES.finditer(attributes):
            key, value = m.group(1).lower(), m.group(2) or m.group(3) or m.group(4) or ""
            if key == "data-y":
                label = value
            else:
                mark = {"class": ".", "id": "#", "role": "@"}[key]
                names += [mark + x.lower() for x in value.split()]
    return Element(tag, tuple(names), label, parent)


def read_blocks(page: str | None) -> list[Block]:
    """The blocks with text, in page order."""
    page = page or ""
    blocks: list[Block] = []
    # Open elements, inline ones too, each with the innermost that is not; how many of each tag.
    stack: list[tuple[Element, Element | None]] = []
    opened: Counter[str] = Counter()
    held: list[str] = []
    linked = 0
    at, n = 0, len(page)

    def flush():
        nonlocal linked
        if held:
            text = _SPACE.sub(" ", html.unescape("".join(held))).strip()
            if text:
                own, place = stack[-1] if stack else (None, None)
                blocks.append(Block(text, place, linked, own.label if own else None))
            held.clear()
        linked = 0

    def close(to: int):
        for o, _ in stack[to:]:
            opened[o.tag] -= 1
        del stack[to:]

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            held.append(page[at:lt])
            if any(o.tag == "a" for o, _ in stack[-4:]):
                linked += lt - at
        if lt == n:
            break
        following = page[lt + 1:lt + 2]
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if following in ("!", "?"):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        name = page[lt + 2:lt + 3] if following == "/" else following
        if not (name.isascii() and name.isalpha()):
            held.append("<")
            at = lt + 1
            continue
        m = _TAG.match(page, lt) or _PLAIN_TAG.match(page, lt)
        if not m:
            break
        at = m.end()
        closing, tag = m.group(1) == "/", m.group(2).lower()
        if tag not in INLINE:
            flush()
        if closing:
            if opened[tag]:
                close(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0].tag == tag))
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = n if end is None else end.end()
            continue
        if tag in VOID or m.group(3).endswith("/"):
            continue
        for ended in CLOSES.get(tag, ()):
            for i in range(len(stack) - 1, -1, -1) if opened[ended] else ():
                if stack[i][0].tag == ended:
                    close(i)
                    break
                if stack[i][0].tag not in INLINE and stack[i][0].tag not in CLOSES:
                    break
        own, place = stack[-1] if stack else (None, None)
        element = _opened(tag, m.group(3), place, own.label if own else None)
        stack.append((element, place if tag in INLINE else element))
        opened[tag] += 1
    flush()
    return blocks
