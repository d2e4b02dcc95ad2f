"""Leaf blocks of an HTML page: runs of text between block-level tags, with the elements above them.

The page is read once from start to end: no place is looked at again because a tag or a quote that begins
there does not end, and open elements are found by their tags, not by a walk over them."""

from __future__ import annotations

import html
import re

#: Kinds of elements in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr"
    " math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom mfenced menclose msub msup msubsup munder mover munderover mmultiscripts mprescripts none"
    " mtable mtr mtd maction semantics annotation annotation-xml".split()
)
HIDDEN = frozenset("annotation annotation-xml head iframe noembed noframes noscript object script style svg template title".split())
#: Start tags that leave an open head open, and those that end an open svg.
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
NOT_SVG = frozenset(
    "article aside b blockquote body br center code dd details div dl dt em figure footer form h1 h2 h3 h4 h5 h6 header hr i img li main menu nav ol p pre section small span strong table td th tr ul".split()
)
#: Hidden elements whose end tag may not be left out, which hide nothing without it.
ENDED = frozenset("noscript object template".split())
#: Elements whose content is text up to their end tag, whatever it looks like.
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
#: What a start tag ends when it is open above: tag -> (tags that it ends, tags that stop the search).
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}

#: Where markup begins: a tag, a comment or another declaration.
_MARKUP = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|[!?/])")
#: The rest of a tag: quotes count in values alone, and one that nothing closes is a character like any other.
_REST = re.compile(r"""((?>[^>=]++|=\s*+(?:"[^"]*"|'[^']*'|[^\s>"'][^\s>]*+)|=)*+)>""")
_ENDS = {tag: re.compile(rf"<(/{'?' if tag == 'noscript' else ''}){tag}\b", re.I) for tag in ENDED}
_RAW_END = {tag: re.compile(f"</{tag}\\b", re.I) for tag in RAW}
_ATTRIBUTE = re.compile(r"""([^\s="'/]+)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_SPACES = re.compile(r"\s+")


class Node:
    """An open element with those above it.  ``tags`` are the different tags of it and of those above that
    are not inline, ``names`` the different words of classes of all; both are shared with the element above
    where it adds nothing, so a chain of many elements costs no more than the words that are new in it."""

    __slots__ = ("tag", "above", "solid", "parent", "tags", "names")

    def __init__(self, tag: str, words, above: Node | None, known: tuple | None):
        self.tag, self.above = tag, above
        inline = tag in INLINE
        self.solid = (above.solid if above else None) if inline else self
        self.parent = "" if inline or not (above and above.solid) else above.solid.tag
        self.tags, self.names = (above.tags, above.names) if above else (_NONE, _NONE)
        if not inline and tag not in self.tags and (known is None or tag in known[0]):
            self.tags |= {tag}
        new = [w for w in words if w not in self.names and (known is None or w in known[1])]
        if new:
            self.names |= {*new}


_NONE: frozenset[str] = frozenset()


class Block:
    """A text, the innermost element around it that isn't inline and that one's parent, and all above it."""

    __slots__ = ("text", "node", "linked", "tag", "parent", "tags", "names")

    def __init__(self, text: str, node: Node | None, linked: int):
        self.text, self.node, self.linked = text, node, linked
        solid = node.solid if node else None
        self.tag, self.parent = (solid.tag, solid.parent) if solid else ("", "")
        self.tags, self.names = (node.tags, node.names) if node else (_NONE, _NONE)

    @property
    def above(self) -> tuple[str, ...]:
        """The tags of all elements around the text that aren't inline, outermost first."""
        out, node = [], self.node.solid if self.node else None
        while node:
            out.append(node.tag)
            node = node.above.solid if node.above else None
        return tuple(out[::-1])


def _words(attributes: str) -> list[str]:
    """Words of the class, id and role of a tag, in lower case."""
    if "=" not in attributes:
        return []
    out: list[str] = []
    for m in _ATTRIBUTE.finditer(attributes):
        if m[1].lower() in ("class", "id", "role", "itemprop"):
            out += [w.lower() for w in _WORD.findall(html.unescape(m[2] or m[3] or m[4] or ""))]
    return out


def _skip(page: str, at: int) -> int:
    """The end of a comment or declaration that begins at ``at``; the page's when it has none."""
    if page.startswith("<!--", at):
        if page.startswith((">", "->"), at + 4):
            return page.index(">", at + 4) + 1
        end = page.find("-->", at + 4)
        return end + 3 if end >= 0 else len(page)
    end = page.find(">", at)
    return end + 1 if end >= 0 else len(page)


def blocks(page: str, known: tuple[frozenset[str], frozenset[str]] | None = None) -> list[Block]:
    """The blocks of a page that hold text, in page order, in time that grows as the page does.

    ``known`` limits the tags and words of classes that blocks list to two sets.  Markup that the page does not
    end (a tag without its ``>``, a comment) goes to the page's end and is no text."""
    out: list[Block] = []
    stack: list[Node] = []
    places: dict[str, list[int]] = {}
    solids: list[int] = []
    parts: list[str] = []
    linked = hidden = 0
    at = 0

    def last(tag: str) -> int:
        """The innermost open element of a tag, or -1."""
        k = places.get(tag)
        return k[-1] if k else -1

    def close() -> None:
        nonlocal linked
        if parts:
            text = parts[0] if len(parts) == 1 else "".join(parts)
            parts.clear()
            text = " ".join(_SPACES.split(html.unescape(text) if "&" in text else text)).strip()
            if text:
                out.append(Block(text, stack[-1] if stack else None, min(linked, len(text))))
        linked = 0

    def pop_to(k: int) -> None:
        nonlocal hidden
        while len(stack) > k:
            tag = stack.pop().tag
            places[tag].pop()
            hidden -= tag in HIDDEN
        while solids and solids[-1] >= k:
            solids.pop()

    def leave_head() -> None:
        """The head ends where something begins that may not stand in it, with a noscript that is open there."""
        k = len(stack) - 1
        if k > 0 and stack[k].tag == "noscript":
            k -= 1
        if k >= 0 and stack[k].tag == "head":
            pop_to(k)

    later: dict[str, re.Match | None] = {}

    def ends_later(tag: str) -> bool:
        """Whether an element's end tag is still to come; a noscript's before the next one."""
        if tag not in later or later[tag] is not None and later[tag].start() < at:
            later[tag] = _ENDS[tag].search(page, at)
        m = later[tag]
        return m is not None and (tag != "noscript" or m[1] == "/")

    while True:
        m = _MARKUP.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if hidden and stack[-1].tag == "head" and text.strip():
            leave_head()
        if text and not hidden:
            parts.append(text)
            if last("a") >= 0:
                linked += len(text.strip())
        if not m:
            break
        if m[2] is None:
            at = _skip(page, m.start())
            continue
        rest = _REST.match(page, m.end())
        if rest is None:
            break
        at = rest.end()
        tag, attributes = m[2].lower(), rest[1]
        if tag not in INLINE:
            close()
        elif tag == "br":
            parts.append(" ")
        if m[1]:
            k = last(tag)
            if k >= 0 and not (tag in INLINE and solids and solids[-1] > k):
                pop_to(k)
            continue
        if hidden:
            if tag not in IN_HEAD:
                leave_head()
            if tag in NOT_SVG and last("svg") > last("foreignobject"):
                pop_to(last("svg"))
        if tag not in INLINE:
            # a block ends the paragraph and the inline elements that are still open
            k = len(stack)
            while k and (stack[k - 1].tag in INLINE or stack[k - 1].tag == "p"):
                k -= 1
            pop_to(k)
            if tag in ENDS:
                mine, stop = ENDS[tag]
                k = max(map(last, mine))
                if k > max(map(last, stop)):
                    pop_to(k)
        if tag in VOID or attributes.endswith("/") and tag in HIDDEN or tag in ENDED and not ends_later(tag):
            continue
        places.setdefault(tag, []).append(len(stack))
        if tag not in INLINE:
            solids.append(len(stack))
        stack.append(Node(tag, _words(attributes), stack[-1] if stack else None, known))
        hidden += tag in HIDDEN
        if tag in RAW:
            end = _RAW_END[tag].search(page, at)
            if not hidden:
                parts.append(page[at : end.start() if end else len(page)])
                close()
            at = _skip(page, end.start()) if end else len(page)
            pop_to(len(stack) - 1)
    close()
    return out
