"""Operator 5: SentencePiece encoding and decoding.

An Aho-Corasick automaton over the pieces reads a text once; at each position its output links give
all pieces that end there, and each relaxes the best that is known for the position.  For a unigram
model the best is the largest sum of scores.  For a BPE model scores are ranks of merges, of which a
sum means nothing; there the best last piece of a prefix is the one whose merges stand beside those of
the last piece before it: each prefix has exactly one (a row of pieces is what the merges give if and
only if each two neighbours are).  The public model that is used here is a BPE model.  Characters
without a piece become their UTF-8 bytes.

No piece crosses from text into a space, so a text is encoded by the chunks that begin with its runs
of spaces; ids of chunks are cached, up to a fixed size.

Null or empty text: no ids.  Null doc_id: reported as null.  Repeated rows: each is encoded.  Ties: of
segmentations with the same sum, the one found first.  Very long texts: encoded whole, chunk by chunk.  Decoding
gives the text back, except that U+2581, the mark for a space, comes back as a space.  Empty table:
an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encode import ChunkCache, text_slices

#: Fixed values of the model's format.
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: What a character without a piece costs below the worst score, in a unigram model.
UNKNOWN_COST = 10.0
ENCODED = "doc_id long, n_ids long, ids_crc32 long, round_trip boolean"


def _fields(data: bytes):
    """(field, value) of a protocol buffer: integers, bytes, or floats as they come."""
    at = 0

    def varint():
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            n = varint()
            yield tag >> 3, data[at : at + n]
            at += n
        else:
            n = 4 if kind == 5 else 8
            yield tag >> 3, struct.unpack("<f" if n == 4 else "<d", data[at : at + n])[0]
            at += n


class PieceModel:
    """Pieces, scores and kinds of a model file."""

    def __init__(self, pieces: list[tuple[str, float, int]], kind: int, dummy_prefix: bool = True):
        self.pieces, self.kind, self.dummy_prefix = pieces, kind, dummy_prefix
        self.usable = {p: (k, s) for k, (p, s, t) in enumerate(pieces) if t in (NORMAL, USER_DEFINED)}
        self.bytes = {int(p[3:5], 16): k for k, (p, _, t) in enumerate(pieces) if t == BYTE}
        self.unknown = next((k for k, (_, _, t) in enumerate(pieces) if t == UNKNOWN), 0)
        if any(SPACE in p.lstrip(SPACE) for p in self.usable):
            raise ValueError("pieces that hold a space inside are not supported")
        self.worst = min((s for _, s in self.usable.values()), default=0.0)
        self.automaton = ahocorasick.Automaton()
        for p, (k, s) in self.usable.items():
            self.automaton.add_word(p, (len(p), k, s))
        self.automaton.make_automaton()
        self.valid = lru_cache(1 << 18)(self._valid)
        written = []
        for p, _, t in pieces:
            written.append(bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t == CONTROL else p.replace(SPACE, " ").encode())
        self.written = written

    @classmethod
    def load(cls, path: str) -> PieceModel:
        with open(path, "rb") as f:
            data = f.read()
        pieces, kind, dummy = [], UNIGRAM, True
        for field, value in _fields(data):
            if field == 1:
                x = dict(_fields(value))
                pieces.append((x[1].decode(), x.get(2, 0.0), x.get(3, NORMAL)))
            elif field == 2:
                kind = dict(_fields(value)).get(3, UNIGRAM)
            elif field == 3:
                x = dict(_fields(value))
                if x.get(2) or x.get(4, 1):
                    raise ValueError("only models without normalisation are supported")
                dummy = bool(x.get(3, 1))
        return cls(pieces, kind, dummy)

    def merged(self, chars: str) -> list[str]:
        """What merging gives: again and again the neighbours whose union scores best, the first of equals."""
        parts = list(chars)
        while len(parts) > 1:
            best = max(((self.usable[a + b][1], -k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.usable), default=None)
            if best is None:
                break
            k = -best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _valid(self, a: int, b: int) -> bool:
        """Whether two pieces stay two when their characters are merged."""
        x, y = self.pieces[a][0], self.pieces[b][0]
        return self.merged(x + y) == [x, y]

    @lru_cache(1 << 17)  # noqa: B019  models live as long as their process
    def valid_alone(self, k: int) -> bool:
        p = self.pieces[k][0]
        return self.merged(p) == [p]

    def segment(self, chunk: str) -> list[int]:
        """Ids of a chunk by one pass of the automaton."""
        n = len(chunk)
        size, last, best = [1] * (n + 1), [-1] * (n + 1), [0.0] + [-np.inf] * n
        ends: list[list] = [[] for _ in range(n + 1)]
        for end, hit in self.automaton.iter(chunk):
            ends[end + 1].append(hit)
        for i in range(1, n + 1):
            if self.kind == BPE:
                for length, k, _ in ends[i]:
                    before = i - length
                    if self.valid_alone(k) and (before == 0 or last[before] < 0 or self.valid(last[before], k)):
                        size[i], last[i] = length, k
                        break
            else:
                for length, k, score in ends[i]:
                    if best[i - length] + score > best[i]:
                        size[i], last[i], best[i] = length, k, best[i - length] + score
                lone = best[i - 1] + self.worst - UNKNOWN_COST
                if chunk[i - 1] not in self.usable and lone > best[i]:
                    size[i], last[i], best[i] = 1, -1, lone
        out: list[int] = []
        i = n
        while i:
            if last[i] >= 0:
                out.append(last[i])
            elif self.bytes:
                out += [self.bytes[b] for b in reversed(chunk[i - 1].encode("utf-8", "surrogatepass"))]
            else:
                out.append(self.unknown)
            i -= size[i]
        return out[::-1]

    def chunks(self, text: str) -> list[str]:
        if not text:
            return []
        return _CHUNK((SPACE if self.dummy_prefix else "") + text.replace(" ", SPACE))

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.written.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text[:1] == " " else text


_CHUNK = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
_models: dict[str, tuple[PieceModel, ChunkCache]] = {}


def loaded(path: str) -> tuple[PieceModel, ChunkCache]:
    """One model and cache for each file and worker process."""
    if path not in _models:
        model = PieceModel.load(path)
        _models[path] = model, ChunkCache(model.chunks, lambda chunks: [model.segment(c) for c in chunks])
    return _models[path]


def encode_pieces(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int) of every text."""

    def run(batches):
        _, cache = loaded(path)
        for batch in batches:
            texts, names = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
            for a, b in text_slices(texts):
                ids, ends = cache.encode(texts[a:b])
                arrays = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(names[a:b], pa.int64()), arrays], ["doc_id", "ids"])

    return _rows(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode_pieces(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of every row of ids."""

    def run(batches):
        model, _ = loaded(path)
        for batch in batches:
            texts = [model.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def encode_report(docs: DataFrame, path: str) -> DataFrame:
    """One row per document: number and crc of its ids, and whether decoding gives the text back."""

    def run(batches):
        model, cache = loaded(path)
        for batch in batches:
            texts, names = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
            for a, b in text_slices(texts):
                flat, ends = cache.encode(texts[a:b])
                ids = np.split(flat, ends[:-1]) if b > a else []
                crcs = [zlib.crc32(np.ascontiguousarray(x, "<u4")) for x in ids]
                same = [model.decode(x.tolist()) == t.replace(SPACE, " ") for x, t in zip(ids, texts[a:b], strict=True)]
                columns = [pa.array(names[a:b], pa.int64()), pa.array(np.diff(ends, prepend=0), pa.int64()), pa.array(crcs, pa.int64()), pa.array(same)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_ids", "ids_crc32", "round_trip"])

    return _rows(docs).mapInArrow(run, ENCODED)
