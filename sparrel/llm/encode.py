"""Whole-text encoding with the tokenizers library, one chunk of text at a time.

Both vocabularies start a new pre-token where white space follows other text, so the ids of a
text are the ids of its chunks, joined.  Chunks repeat a lot; each worker keeps the ids of
those it has seen in a cache of bounded size.  A chunk is never cut.  Special tokens that stand in
a text (``<|endoftext|>``) have their own ids, as in the library's plain call; they hold no white space and
begin with a sign that no chunk begins after, so they are never cut either.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np

#: The characters with the Unicode property White_Space.
UNICODE_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: ASCII punctuation that forms one pre-token with more of it; the apostrophe may start a contraction.
PUNCTUATION = ".,;:!?*%#$&|"

_END = f"(?=[{UNICODE_SPACE}]|\\Z)"
#: kind -> pattern of chunks.  "word" vocabularies drop white space; "byte" ones keep it.  Of the latter, a
#: word of Latin-1 letters is a chunk without the run of punctuation between it and the next white space,
#: which is another: a pre-token ends there too, and far fewer chunks are new.
CHUNKS = {
    "word": re.compile(f"[^{UNICODE_SPACE}]+"),
    "byte": re.compile(
        f" ?[A-Za-zÀ-ÖØ-öø-ÿ]++(?=[{PUNCTUATION}]*+{_END})|[{PUNCTUATION}]++{_END}|[{UNICODE_SPACE}]*[^{UNICODE_SPACE}]+|[{UNICODE_SPACE}]+"
    ),
}

#: Characters of text in the cache; beyond it the cache starts anew.
CACHE_CHARS = 8_000_000


def _byte_letters() -> dict[int, str]:
    """What the byte-level alphabet writes for the letters of Latin-1: printable bytes stand for
    themselves, the others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spelled = {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(sorted(set(range(256)) - {*plain}))}
    return {c: "".join(spelled[b] for b in chr(c).encode()) for c in range(256) if chr(c).isalpha() or c == 32}



def _words(text: str) -> list[str]:
    """What CHUNKS["word"] finds; str.split does the same where none of the separators that only it
    takes for white space occur."""
    if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
        return CHUNKS["word"].findall(text)
    return text.split()


class _Codes(dict):
    """Numbers chunks as they are first asked for."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        n = self[chunk] = len(self)
        self.new.append(chunk)
        return n


class ChunkCache:
    """Ids of texts from the ids of their chunks.  ``find`` cuts a text into chunks, ``ask`` gives the
    ids of chunks that are not in the cache."""

    def __init__(self, find, ask):
        self.find, self.ask = find, ask
        self._clear()

    def _clear(self) -> None:
        self.code = _Codes()
        self.chars = 0
        self.flat = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.first = np.zeros(1 << 16, np.int64)
        self.size = np.zeros(1 << 16, np.int64)

    def _learn(self, known: int, chunks: list[str]) -> None:
        """Ids of new chunks, whose codes start at ``known``."""
        n = known + len(chunks)
        if n > len(self.size):
            self.first, self.size = (np.resize(a, 2 * n) for a in (self.first, self.size))
        ids = self.ask(chunks)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        new = np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum()))
        end = self.used + len(new)
        if end > len(self.flat):
            self.flat = np.resize(self.flat, 2 * end)
        self.flat[self.used : end] = new
        self.size[known:n] = sizes
        self.first[known:n] = self.used + np.cumsum(sizes) - sizes
        self.used = end
        self.chars += sum(map(len, chunks))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's ids end."""
        if self.chars > CACHE_CHARS:
            self._clear()
        found = [self.find(t) for t in texts]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        known = len(self.code)
        codes = np.fromiter(map(self.code.__getitem__, chain.from_iterable(found)), np.int64, int(counts.sum()))
        if self.code.new:
            self._learn(known, self.code.new)
            self.code.new = []
        sizes = self.size[codes]
        ends = np.cumsum(sizes)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.first[codes] - (ends - sizes), sizes)
        ends = np.concatenate(([0], ends))
        return self.flat[at], ends[np.cumsum(counts)]


class ChunkEncoder(ChunkCache):
    """Ids of the tokenizers library under the vocabulary at ``path``."""

    def __init__(self, path: str, kind: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model_ids = self.tokenizer.model.tokenize
        self.keeps_space = kind == "byte"
        self.spelling = _byte_letters()
        super().__init__(CHUNKS[kind].findall if self.keeps_space else _words, self._ids)

    def _word(self, chunk: str) -> list[int] | None:
        """Ids of a chunk that is one word of Latin-1 letters and perhaps a run of punctuation: its
        pre-tokens are plain to see, so the model is asked directly.  None for all others."""
        word = chunk.rstrip(PUNCTUATION)
        bare = word[1:] if self.keeps_space and word[:1] == " " else word
        if not bare.isalpha() or not (bare.isascii() or max(bare) <= "\xff"):
            return None
        end = chunk[len(word) :]
        word = (word if self.keeps_space else word.lower()).translate(self.spelling)
        ids = [t.id for t in self.model_ids(word)]
        return ids + [t.id for t in self.model_ids(end)] if end else ids

    def _ids(self, chunks: list[str]) -> list[list[int]]:
        ids = [self._word(c) for c in chunks]
        rest = [k for k, x in enumerate(ids) if x is None]
        for k, e in zip(rest, self.tokenizer.encode_batch_fast([chunks[k] for k in rest], add_special_tokens=False), strict=True):
            ids[k] = e.ids
        return ids


_encoders: dict[tuple[str, str], ChunkEncoder] = {}


def encoder(path: str, kind: str) -> ChunkEncoder:
    """One encoder for each vocabulary and worker process, kept from task to task."""
    if (path, kind) not in _encoders:
        _encoders[path, kind] = ChunkEncoder(path, kind)
    return _encoders[path, kind]


def forget() -> None:
    """Give back the encoders of a worker process that turns to other work."""
    _encoders.clear()


def text_slices(texts, most: int = 1 << 20):
    """(first, last) of runs of rows with about ``most`` characters, one row at least."""
    start = held = 0
    for k, t in enumerate(texts):
        n = len(t)
        if k > start and held + n > most:
            yield start, k
            start, held = k, 0
        held += n
    if start < len(texts):
        yield start, len(texts)
