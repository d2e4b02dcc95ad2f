"""Hashes of words and word shingles of many texts at once, on arrays of bytes.

Words are runs of bytes other than white space, with A-Z lower-cased.  A word's hash is a
polynomial in its bytes modulo 2**64, each byte replaced by a random number, then mixed; a
shingle's hash mixes the hashes of its words.  Bytes are taken in blocks that end at white space,
so memory follows the words of a text, not several times its bytes.  ``core_words`` leaves out the
punctuation at the edges of words, and words of punctuation alone.
"""

from __future__ import annotations

import numpy as np

BLOCK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_rng = np.random.default_rng(0x5EED)
_LETTER = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
for _c in range(65, 91):
    _LETTER[_c] = _LETTER[_c + 32]


#: ASCII punctuation and symbols.
_MARK = np.zeros(256, bool)
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
#: Second bytes, after C2, of the no-break space and of signs such as (c) and guillemets.
_LATIN_MARK = np.zeros(256, bool)
_LATIN_MARK[[0xA0, 0xA7, 0xA9, 0xAB, 0xAE, 0xB6, 0xB7, 0xBB]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser of 64-bit hashes (as in MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


#: The hash of a word of no bytes.
_NOTHING = mix(np.zeros(1, np.uint64))[0]


class _Powers:
    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int):
        if n > len(cls.up):
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                out = np.full(n, base, np.uint64)
                out[0] = 1
                setattr(cls, name, np.multiply.accumulate(out))
        return cls.up, cls.down


def _marks(b: np.ndarray) -> np.ndarray:
    """Bytes of punctuation: ASCII, U+2000 to U+203F and the signs of Latin-1."""
    out = _MARK[b]
    k = np.flatnonzero((b[:-2] == 0xE2) & (b[1:-1] == 0x80))
    out[k] = out[k + 1] = out[k + 2] = True
    k = np.flatnonzero((b[:-1] == 0xC2) & _LATIN_MARK[b[1:]])
    out[k] = out[k + 1] = True
    return out


def _hash_block(b: np.ndarray, core: bool = False) -> tuple[np.ndarray, np.ndarray]:
    word = ~_SPACE[b]
    edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    if core:
        inner = word & ~_marks(b)
        places, count = np.flatnonzero(inner), np.concatenate([[0], np.cumsum(inner)])
        first, last = count[starts], count[ends]
        bare = first == last
        keep = ~bare
        # words of marks alone keep their place, as words of no bytes
        starts, ends = starts.copy(), ends.copy()
        starts[keep], ends[keep] = places[first[keep]], places[last[keep] - 1] + 1
        ends[bare] = starts[bare]
    up, down = _Powers.of(len(b) + 1)
    sums = np.empty(len(b) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_LETTER[b] * up[: len(b)], out=sums[1:])
    return starts, mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def core_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and begins as of ``hash_words``, of words without the punctuation at their edges, and the
    number of each among all words of its text."""
    words, at = hash_words(texts, True)
    held = np.flatnonzero(words != _NOTHING)
    return words[held], np.searchsorted(held, at), held - np.repeat(at[:-1], np.diff(np.searchsorted(held, at)))


def hash_words(texts: list[str], core: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and where each text's words begin (one more entry than texts)."""
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(parts), np.uint8)
    begins = np.cumsum(np.array([0, *(len(p) + 1 for p in parts)], np.int64))
    places, hashes, at = [], [], 0
    while at < len(data):
        end = at + BLOCK_BYTES
        if end < len(data):
            gap = np.flatnonzero(_SPACE[data[at:end]])
            if len(gap):
                end = at + int(gap[-1]) + 1
            else:
                while end < len(data) and not _SPACE[data[end]]:
                    end += 1
        starts, h = _hash_block(data[at:end], core)
        places.append(starts + at)
        hashes.append(h)
        at = end
    if not places:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(places), begins)


def shingle(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of each run of ``size`` words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n] * _PLACE[0]
    for k in range(1, size):
        out += words[k : k + n] * _PLACE[k]
    return mix(out + np.uint64(size))


def text_shingles(texts: list[str], size: int = 5) -> list[np.ndarray]:
    """Of each text the shingle hashes in order; a text of fewer words is one shingle, none is none."""
    words, at = hash_words(texts)
    every = shingle(words, size)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        n = b - a
        out.append(every[a : b - size + 1] if n >= size else shingle(words[a:b], n) if n else every[:0])
    return out
