"""Operator 6: token counts that follow edits.

The state of a document is its text and a segment tree over groups of about 32 pre-tokens: each element has
the sums of characters and tokens of its subtree.  An edit is located by walking down the sums of characters.
Pre-tokens are cut anew from the start of the group before the edit, because a pre-token may look at what
follows it, up to the first place behind the edit where an old group begins: how a text is cut from a place on
depends on nothing before it, so all that follows stands.  Only these groups are encoded again; they take the
place of the old ones in the tree, and the sums above them are updated.  All other parts of the tree stay as
they are, are not even unpacked when a state is read, and are copied as they lie when it is written.

Null or empty text: no tokens.  Strings of special tokens: ordinary text.  Null doc_id: reported as null; edits
never meet it.  Repeated rows (ties): each has its own state, and an edit of their doc_id is done to each.  Edits
beyond the end of a text act at its end.  Very long texts: an edit costs what it touches, and the copying of the
rest.  Empty table: an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import os
import struct

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUP = 32
#: Pre-tokens whose counts a worker keeps; beyond it the cache starts anew.
CACHED = 400_000
#: Half the children that an element of a tree has at most.
FAN = 16
#: Characters behind its end that may decide where a pre-token ends, with room to spare.
AHEAD = 8
STATE = "doc_id long, text string, tree binary"
EDITED = STATE + ", n_tokens long, n_tokens_before long, n_encoded long"


class Counter:
    """Tokens of a pre-token under a byte-level vocabulary."""

    def __init__(self, path: str, pattern: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.pattern = regex.compile(pattern)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        odd = sorted(set(range(256)) - {*plain})
        self.letter = {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(odd)}
        self.known: dict[str, int] = {}

    def _ask(self, token: str) -> int:
        n = self.known[token] = len(self.tokenizer.model.tokenize("".join(map(self.letter.__getitem__, token.encode("utf-8", "surrogatepass")))))
        return n

    def counts(self, tokens: list[str]) -> np.ndarray:
        if len(self.known) > CACHED:
            self.known = {}
        known, ask = self.known, self._ask
        return np.fromiter((known[t] if t in known else ask(t) for t in tokens), np.int64, len(tokens))

    def groups(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Characters and tokens of each group of pre-tokens."""
        if not tokens:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.arange(0, len(tokens), GROUP)
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        return np.add.reduceat(sizes, at), np.add.reduceat(self.counts(tokens), at)


class Node:
    """An element of a tree: sums of its subtree, and its children or, at a leaf, its characters.  One that was
    read from a stored tree and not yet looked into holds its place there instead."""

    __slots__ = ("chars", "tokens", "kids", "text", "stored")

    def __init__(self, chars: int, tokens: int, kids=None, text=None, stored=None):
        self.chars, self.tokens, self.kids, self.text, self.stored = chars, tokens, kids, text, stored


class Stored:
    """A tree as it lies in a state: of each level, from the leaves up, the sums of its elements and, above the
    leaves, where their children begin.  Nothing but the arrays' ends is looked at when it is read."""

    def __init__(self, blob: bytes, text: str):
        self.text, self.levels = text, []
        n_levels = struct.unpack_from("<q", blob)[0]
        at = 8 + 8 * n_levels
        for k in range(n_levels):
            n = struct.unpack_from("<q", blob, 8 + 8 * k)[0]
            columns = []
            for size in (n, n, n + 1 if k else 0):
                columns.append(np.frombuffer(blob, "<i8", size, at))
                at += 8 * size
            self.levels.append(columns)

    @staticmethod
    def blob(levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> bytes:
        """Levels of (characters, tokens, numbers of children)."""
        out = [struct.pack(f"<{1 + len(levels)}q", len(levels), *(len(x[0]) for x in levels))]
        for k, (chars, tokens, kids) in enumerate(levels):
            out += [chars.astype("<i8").tobytes(), tokens.astype("<i8").tobytes()]
            if k:
                out.append(np.concatenate(([0], np.cumsum(kids))).astype("<i8").tobytes())
        return b"".join(out)


def _bulk(chars: np.ndarray, tokens: np.ndarray) -> bytes:
    """The stored tree over these leaves."""
    levels = [(chars, tokens, chars[:0])]
    while len(levels[-1][0]) > 1:
        chars, tokens, _ = levels[-1]
        at = np.arange(0, len(chars), FAN)
        levels.append((np.add.reduceat(chars, at), np.add.reduceat(tokens, at), np.diff(np.append(at, len(chars)))))
    return Stored.blob(levels if len(chars) else [])


class CountTree:
    """Token counts of one text under edits.

    A tree with up to 2 * ``FAN`` children an element over groups of pre-tokens, each of which holds its own
    characters.  An edit walks down by the sums of characters, cuts the text anew from the group before it to
    the first place behind it where an old group begins, encodes these groups, puts them in the place of the old
    ones and updates the sums on the way up.  ``looked_at`` counts the elements that edits have met."""

    def __init__(self, counter: Counter, text: str, tree: bytes):
        self.counter, self.looked_at = counter, 0
        stored = Stored(tree, text)
        self.height = max(0, len(stored.levels) - 1)
        self.root = None
        if stored.levels:
            self.root = Node(int(stored.levels[-1][0][0]), int(stored.levels[-1][1][0]), stored=(stored, self.height, 0, 0))

    @classmethod
    def of(cls, counter: Counter, text: str) -> CountTree:
        return cls(counter, text, _bulk(*counter.groups(counter.pattern.findall(text))))

    @property
    def n_tokens(self) -> int:
        return self.root.tokens if self.root else 0

    @property
    def n_chars(self) -> int:
        return self.root.chars if self.root else 0

    @property
    def text(self) -> str:
        return "".join(self._texts())

    def _kids(self, node: Node) -> list[Node]:
        if node.kids is None:
            stored, level, k, base = node.stored
            chars, tokens, _ = stored.levels[level - 1]
            first, last = stored.levels[level][2][k : k + 2].tolist()
            node.kids = []
            for j, (n, t) in enumerate(zip(chars[first:last].tolist(), tokens[first:last].tolist(), strict=True), first):
                node.kids.append(Node(n, t, stored=(stored, level - 1, j, base)))
                base += n
            node.stored = None
        self.looked_at += len(node.kids)
        return node.kids

    @staticmethod
    def _text(leaf: Node) -> str:
        if leaf.text is None:
            stored, _, _, base = leaf.stored
            leaf.text, leaf.stored = stored.text[base : base + leaf.chars], None
        return leaf.text

    def _leaf(self, offset: int) -> tuple[list[tuple[Node, int]], int]:
        """The way to the leaf that holds the offset (the last one, beyond the end), and where the leaf begins."""
        way, node, begin = [], self.root, 0
        for _ in range(self.height):
            kids, k = self._kids(node), 0
            while k < len(kids) - 1 and offset - begin >= kids[k].chars:
                begin += kids[k].chars
                k += 1
            way.append((node, k))
            node = kids[k]
        return way, begin

    def _at(self, way) -> Node:
        return self._kids(way[-1][0])[way[-1][1]] if way else self.root

    def _move(self, way, step: int):
        """The way to the next leaf, or the one before; None where there is none."""
        way = list(way)
        while way:
            node, k = way.pop()
            if 0 <= k + step < len(self._kids(node)):
                way.append((node, k + step))
                while len(way) < self.height:
                    node = self._at(way)
                    way.append((node, 0 if step > 0 else len(self._kids(node)) - 1))
                return way
        return None

    def edit(self, start: int, end: int, new: str) -> int:
        """Replace text[start:end] by ``new``; returns the pre-tokens that were encoded."""
        n = self.n_chars
        start, end = min(start, n), min(max(start, end), n)
        way, begin = self._leaf(start) if self.root else (None, 0)
        if way:
            before = self._move(way, -1)
            if before:
                way, begin = before, begin - self._at(before).chars
        window, upto, ends = [], begin, []
        more = way if self.root else None

        def pull(least: int) -> None:
            """Take leaves into the window up to a place."""
            nonlocal more, upto
            while more is not None and (upto < least or not window):
                leaf = self._at(more)
                window.append(self._text(leaf))
                upto += leaf.chars
                ends.append(upto)
                more = self._move(more, 1)

        pull(end)
        text = "".join(window)
        text = text[: start - begin] + new + text[end - begin :]
        window.clear()
        shift, behind = len(new) - (end - start), start + len(new) - begin
        cut, at, until = [], 0, None
        while until is None:
            old = {e + shift - begin for e in ends if e >= end}
            for found in self.counter.pattern.finditer(text, at):
                if more is not None and found.end() + AHEAD > len(text):
                    break
                cut.append(found.group())
                at = found.end()
                if at >= behind and at in old:
                    until = begin + at - shift
                    break
            if until is None:
                if more is None:
                    until = n
                else:
                    pull(upto + max(4 * AHEAD, upto - begin))
                    text += "".join(window)
                    window.clear()
        chars, tokens = self.counter.groups(cut)
        fresh, place = [], 0
        for size, count in zip(chars.tolist(), tokens.tolist(), strict=True):
            fresh.append(Node(size, count, text=text[place : place + size]))
            place += size
        self._put(begin, until, fresh)
        return len(cut)

    def _put(self, begin: int, until: int, fresh: list[Node]) -> None:
        nodes = self._replace(self.root, self.height, begin, until, fresh) if self.root else fresh
        while len(nodes) > 1:
            nodes = self._parents(nodes)
            self.height += 1
        self.root = nodes[0] if nodes else None
        while self.height and len(self._kids(self.root)) == 1:
            self.root = self._kids(self.root)[0]
            self.height -= 1
        if self.root is None:
            self.height = 0

    def _parents(self, kids: list[Node]) -> list[Node]:
        """As few elements of even size as hold these children; none is over-full."""
        n = -(-len(kids) // (2 * FAN))
        out = []
        for k in range(n):
            mine = kids[len(kids) * k // n : len(kids) * (k + 1) // n]
            out.append(Node(sum(x.chars for x in mine), sum(x.tokens for x in mine), mine))
        return out

    def _replace(self, node: Node, height: int, a: int, b: int, fresh: list[Node]) -> list[Node]:
        """The elements that take the place of ``node`` when its leaves from a to b give way to ``fresh``."""
        if height == 0:
            return fresh
        kids: list[Node] = []
        at = 0
        mine = self._kids(node)
        placed = False
        for k, x in enumerate(mine):
            end = at + x.chars
            here = not placed and (a < end or k == len(mine) - 1)
            if here or a < end and at < b:
                kids += self._replace_kid(x, height - 1, max(a - at, 0), min(b, end) - at, fresh if here else [])
                placed = True
            else:
                kids.append(x)
            at = end
        return self._parents(kids) if kids else []

    def _replace_kid(self, kid: Node, height: int, a: int, b: int, fresh: list[Node]) -> list[Node]:
        if height == 0:
            # a leaf is replaced whole, or stays beside what is put before or behind it
            return fresh if a < b else [*fresh, kid] if a == 0 else [kid, *fresh]
        if a == 0 and b == kid.chars and not fresh:
            return []
        return self._replace(kid, height, a, b, fresh)

    # back into a state
    def _texts(self):
        todo = [(self.root, self.height)] if self.root else []
        while todo:
            node, height = todo.pop()
            if node.stored is not None:
                stored, _, _, base = node.stored
                yield stored.text[base : base + node.chars]
            elif height == 0:
                yield node.text
            else:
                todo += [(x, height - 1) for x in reversed(node.kids)]

    def tree(self) -> bytes:
        """The tree as it is stored; parts that no edit met are copied as they are."""
        levels: list[list] = [[] for _ in range(self.height + 1 if self.root else 0)]
        todo = [(self.root, self.height)] if self.root else []
        while todo:
            node, height = todo.pop()
            if node.stored is not None:
                stored, _, first, _ = node.stored
                last = first + 1
                for level in range(height, -1, -1):
                    chars, tokens, starts = stored.levels[level]
                    levels[level].append((chars[first:last], tokens[first:last], np.diff(starts[first : last + 1]) if level else chars[:0]))
                    if level:
                        first, last = int(starts[first]), int(starts[last])
            else:
                levels[height].append(([node.chars], [node.tokens], [len(node.kids)] if height else []))
                todo += [(x, height - 1) for x in reversed(node.kids or ())]
        return Stored.blob([tuple(np.concatenate([np.asarray(x, np.int64) for x in c]) for c in zip(*parts, strict=True)) for parts in levels])


_counters: dict[tuple[str, str], Counter] = {}


def counter(path: str, pattern: str) -> Counter:
    if (path, pattern) not in _counters:
        _counters[path, pattern] = Counter(path, pattern)
    return _counters[path, pattern]


def count_states(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """The state of every document."""

    def run(batches):
        c = counter(path, pattern)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                trees = [_bulk(*c.groups(c.pattern.findall(t))) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), pa.array(trees, pa.binary())], ["doc_id", "text", "tree"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, STATE)


def apply_edits(states: DataFrame, path: str, pattern: str) -> DataFrame:
    """States after their edits: ``states`` with a column ``edits``, an array of (start, end, new) to be
    done in order, or null.  Adds n_tokens, n_tokens_before and n_encoded (pre-tokens encoded again)."""

    def run(batches):
        c = counter(path, pattern)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                rows = []
                for text, tree, edits in zip(*(part.column(n).to_pylist() for n in ("text", "tree", "edits")), strict=True):
                    t = CountTree(c, text, tree)
                    before = t.n_tokens
                    done = sum(t.edit(e["start"], e["end"], e["new"] or "") for e in edits or ())
                    rows.append((t.text, t.tree(), t.n_tokens, before, done))
                text, trees, now, before, done = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(text, pa.string()), pa.array(trees, pa.binary()), *(pa.array(x, pa.int64()) for x in (now, before, done))],
                    ["doc_id", "text", "tree", "n_tokens", "n_tokens_before", "n_encoded"],
                )

    return states.select("doc_id", "text", "tree", "edits").mapInArrow(run, EDITED)


def middle_edits(states: DataFrame, new: str = " edited, and again ", most: int = 40) -> DataFrame:
    """States with one edit each: ``most`` characters in the middle of the text give way to ``new``."""
    middle = F.floor(F.char_length("text") / 2).cast("long")
    edit = F.struct(middle.alias("start"), (middle + F.lit(most)).alias("end"), F.lit(new).alias("new"))
    return states.withColumn("edits", F.array(edit))
