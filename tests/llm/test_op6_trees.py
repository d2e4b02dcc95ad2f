"""Trees of token counts: what an edit touches, and trees that are stored and read between edits."""

import random
import time

import public_tokenizers
import pytest

from sparrel.llm import token_counts
from sparrel.llm.token_counts import FAN, GROUP, CountTree

BYTE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def counter():
    return token_counts.Counter(BYTE, public_tokenizers.PATTERN)


def prose(r, n):
    return " ".join("".join(r.choice("abcdefg") for _ in range(r.randint(1, 7))) for _ in range(n))


def whole(counter, text):
    return int(counter.counts(counter.pattern.findall(text)).sum())


def check(tree):
    """Sums, sizes and heights of all elements."""

    def walk(node, height):
        if height == 0:
            assert node.chars == len(tree._text(node)) > 0
            return
        kids = tree._kids(node)
        assert 0 < len(kids) <= 2 * FAN
        assert node.chars == sum(k.chars for k in kids) and node.tokens == sum(k.tokens for k in kids)
        for k in kids:
            walk(k, height - 1)

    if tree.root:
        walk(tree.root, tree.height)


def test_an_edit_touches_as_much_in_a_long_text_as_in_a_short_one(counter):
    r = random.Random(1)
    looked, took = {}, {}
    for n in (20_000, 80_000, 320_000):
        text = prose(r, n)
        blob = CountTree.of(counter, text).tree()
        looked[n], took[n] = [], []
        for place in (10, len(text) // 3, len(text) - 10):
            for _ in range(5):
                tree = CountTree(counter, text, blob)
                began = time.perf_counter()
                encoded = tree.edit(place, place + 20, " some new words ")
                took[n].append(time.perf_counter() - began)
                looked[n].append(tree.looked_at)
                assert encoded <= 5 * GROUP
    levels = 5
    assert max(looked[320_000]) <= 2 * FAN * levels * 6
    assert max(looked[320_000]) <= 2 * max(looked[20_000])
    assert sorted(took[320_000])[7] <= 1.5 * sorted(took[20_000])[7] + 2e-3, took


def test_edits_between_writes(counter):
    r = random.Random(2)
    bits = [" ", "  ", "\n", "'s", "'", "l", "a", "é", " \n x", "12", "...", "日本", " " * 300, "b" * 400]
    for words in (0, 1, 30, 3000):
        text = prose(r, words)
        tree = CountTree.of(counter, text)
        for step in range(80):
            a = r.randrange(len(text) + 2)
            b = a + r.choice([0, 0, 1, 3, 30, 2000, len(text)] if step % 20 == 0 else [0, 0, 1, 3, 30])
            new = "".join(r.choice(bits) for _ in range(r.randrange(5))) if step % 7 else prose(r, r.randrange(800))
            text = text[:a] + new + text[max(a, b) :]
            tree.edit(a, b, new)
            assert tree.n_chars == len(text) and tree.n_tokens == whole(counter, text)
            if step % 5 == 0:
                check(tree)
                assert tree.text == text
                blob = tree.tree()
                tree = CountTree(counter, text, blob)
                assert tree.tree() == blob


def test_one_pre_token_without_end(counter):
    text = "a" * 200_000
    tree = CountTree.of(counter, text)
    tree.edit(100, 101, "bb")
    assert tree.n_chars == 200_001
    tree.edit(5, 200_001, " x")
    assert tree.text == "aaaaa x" and tree.n_tokens == whole(counter, "aaaaa x")


def test_unread_parts_are_copied(counter):
    text = prose(random.Random(4), 5000)
    blob = CountTree.of(counter, text).tree()
    tree = CountTree(counter, text, blob)
    assert tree.tree() == blob and tree.text == text and tree.looked_at == 0
    tree.edit(10, 10, "")
    assert tree.root.kids is not None and any(k.stored for k in tree.root.kids)
    again = CountTree(counter, text, tree.tree())
    check(again)
    assert again.text == text
