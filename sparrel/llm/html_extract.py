"""Operator 10: main text of HTML pages by a linear-chain conditional random field.

A page is cut into leaf blocks.  Each has features of the elements above it (tags, words of their
classes and ids), of its text (length, links, punctuation) and of its neighbours.  The model is
trained on ``TRAINING_PAGES`` labelled pages of random layouts by gradient steps on the conditional
likelihood (forward-backward) and decoded by Viterbi.  The blocks labelled main text are joined by
line feeds.

Null or empty html, or no main text: an empty text.  Null page_id or url: reported as null.  Repeated
rows: each is extracted.  Ties: of labellings that score the same, the one with the earlier label is taken.  Very
long, deep or broken pages: read as a whole, in time that grows as the page does.  Empty table: an empty result.
Other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_blocks import Block, blocks
from .html_pages import labelled_page

#: Bound of the training sample, passes over it, step, and weight of the quadratic penalty.
TRAINING_PAGES, PASSES, STEP, PENALTY = 1200, 6, 0.1, 1e-5
#: Kinds of places in a page whose scores are kept.
MOST_CONTEXTS = 1 << 16
TEXTS = "page_id long, url string, text string, n_chars long"


def context_features(b: Block) -> list[str]:
    """Names of the features of the elements above a block."""
    f = ["bias", f"tag={b.tag}", f"parent={b.parent}"]
    f += [f"above={t}" for t in sorted(b.tags)]
    return f + [f"name={w}" for w in sorted(b.names)]


def text_kind(text: str, linked: int, edge: bool | None) -> tuple:
    """What of a block's text and place counts: size, share of links, last and first sign, edge of the page."""
    words = text.count(" ") + 1
    size = words.bit_length() if words < 8 else 4 + (words >= 30)
    return size, 4 * linked // len(text), text[-1] in '.!?:;…”"\'', text[0] in "©®|»›·", edge


def text_features(kind: tuple) -> list[str]:
    """Names of the features of a block's text and place."""
    size, links, end, sign, edge = kind
    return [f"words={size}", f"links={links}", f"end={end}", f"sign={sign}", *([] if edge is None else [f"edge={edge}"])]


def text_kinds(row: list[Block]) -> list[tuple]:
    n = len(row) - 1
    return [text_kind(b.text, b.linked, k == 0 if k in (0, n) else None) for k, b in enumerate(row)]


def features(row: list[Block]) -> list[list[str]]:
    """Names of the features that hold for each block."""
    return [context_features(b) + text_features(k) for b, k in zip(row, text_kinds(row), strict=True)]


class BlockModel:
    """Weights of (feature, label) and of (label, next label)."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, moves: np.ndarray):
        self.names, self.weights, self.moves = names, weights, moves
        self.weight = dict(zip(names, weights.tolist(), strict=True))
        #: The tags and words of classes that the model has weights for; others change nothing.
        self.known = tuple(frozenset(x[len(kind) :] for x in names if x.startswith(kind)) for kind in ("above=", "name="))
        self.contexts: dict[tuple, tuple[float, float]] = {}
        self.kinds: dict[tuple, tuple[float, float]] = {}

    def _sum(self, names: list[str]) -> tuple[float, float]:
        held = [self.weight[x] for x in names if x in self.weight]
        return sum(x for x, _ in held), sum(y for _, y in held)

    def scores(self, row: list[Block]) -> list[tuple[float, float]]:
        """Of each label for each block; sums are kept for elements alike and for texts alike."""
        if len(self.contexts) > MOST_CONTEXTS:
            self.contexts.clear()
        contexts, kinds, out = self.contexts, self.kinds, []
        for b, kind in zip(row, text_kinds(row), strict=True):
            key = b.tag, b.parent, b.tags, b.names
            if (above := contexts.get(key)) is None:
                above = contexts[key] = self._sum(context_features(b))
            if (text := kinds.get(kind)) is None:
                text = kinds[kind] = self._sum(text_features(kind))
            out.append((above[0] + text[0], above[1] + text[1]))
        return out

    def decode(self, row: list[Block]) -> list[int]:
        """The best labels, by Viterbi."""
        if not row:
            return []
        s, m = self.scores(row), self.moves.tolist()
        (m00, m01), (m10, m11) = m
        a, b, back = s[0][0], s[0][1], []
        for x, y in s[1:]:
            to0, other0, to1, other1 = a + m00, b + m10, a + m01, b + m11
            back.append((to0 < other0, to1 < other1))
            a, b = (to0 if to0 >= other0 else other0) + x, (to1 if to1 >= other1 else other1) + y
        label = 0 if a >= b else 1
        out = [label]
        for step in reversed(back):
            label = int(step[label])
            out.append(label)
        return out[::-1]

    def main_text(self, page: str) -> str:
        row = blocks(page, self.known)
        return "\n".join(b.text for b, label in zip(row, self.decode(row), strict=True) if label)


def _expected(s: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of each label and each move under the model, by forward and backward sums."""
    n = len(s)
    ahead, behind = np.empty((n, 2)), np.zeros((n, 2))
    ahead[0] = s[0]
    for k in range(1, n):
        ahead[k] = s[k] + np.logaddexp(ahead[k - 1, 0] + moves[0], ahead[k - 1, 1] + moves[1])
    for k in range(n - 2, -1, -1):
        x = s[k + 1] + behind[k + 1]
        behind[k] = np.logaddexp(moves[:, 0] + x[0], moves[:, 1] + x[1])
    total = np.logaddexp(*ahead[-1])
    pairs = ahead[:-1, :, None] + moves + (s[1:] + behind[1:])[:, None, :] - total
    return np.exp(ahead + behind - total), np.exp(pairs).sum(axis=0)


@lru_cache(1)
def trained(pages: int = TRAINING_PAGES, seed: int = 0) -> BlockModel:
    """The model; the same for the same arguments."""
    rows, gold = [], []
    for k in range(pages):
        page, labels = labelled_page(seed + k)
        row = blocks(page)
        if [b.text for b in row] != [" ".join(t.split()) for t, _ in labels]:
            continue  # a random layout whose blocks run together
        rows.append(features(row))
        gold.append(np.array([x for _, x in labels]))
    names: dict[str, int] = {}
    for row in rows:
        for f in row:
            for x in f:
                names.setdefault(x, len(names))
    coded = [[np.array([names[x] for x in f]) for f in row] for row in rows]
    weights, moves = np.zeros((len(names), 2)), np.zeros((2, 2))
    squares, move_squares = np.full(weights.shape, 1e-8), np.full((2, 2), 1e-8)
    order = np.random.default_rng(seed)
    for _ in range(PASSES):
        for k in order.permutation(len(coded)):
            row, want = coded[k], gold[k]
            s = np.array([weights[f].sum(axis=0) for f in row])
            each, pairs = _expected(s, moves)
            each[np.arange(len(want)), want] -= 1
            flat = np.concatenate(row)
            slope = np.zeros_like(weights)
            np.add.at(slope, flat, np.repeat(each, [len(f) for f in row], axis=0))
            np.subtract.at(pairs, (want[:-1], want[1:]), 1)
            touched = np.unique(flat)
            g = slope[touched] + PENALTY * weights[touched]
            squares[touched] += g * g
            weights[touched] -= STEP * g / np.sqrt(squares[touched])
            move_squares += pairs * pairs
            moves -= STEP * pairs / np.sqrt(move_squares)
    return BlockModel(names, weights, moves)


def extract(pages: DataFrame, model: BlockModel | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    model = model or trained()

    def run(batches):
        for batch in batches:
            ids, urls, sources = (batch.column(c) for c in ("page_id", "url", "html"))
            texts = [model.main_text(h.as_py()) for h in sources]
            yield pa.RecordBatch.from_arrays([ids, urls, pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html")).mapInArrow(run, TEXTS)
