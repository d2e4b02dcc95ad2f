"""Operator 8: packing documents into sequences of at most 1024 tokens.

Bounded-space online packing.  Each partition streams its documents: pieces of a whole sequence are
emitted at once, the rest of a document goes into the open window that it fills best.  A fixed
number of windows is open; when the piece fits into none and no further may be opened, the fullest
is emitted.  What is open at the end is left over: the pieces of left-over windows of a bounded
number of partitions are merged, one after another, cut where a sequence is full, so each such group
pads one sequence at most.

Null or empty text: the end id alone.  Null doc_id: packed like any other.  Repeated rows: each is
packed.  Very long texts: many sequences.  Empty table: an empty result.  Other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .encode import encoder, text_slices

SEQUENCE, OPEN_WINDOWS = 1024, 64
#: Partitions whose left-over windows are merged in one task.
MERGED_PARTITIONS = 32
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class Windows:
    """Open windows by free room; a piece goes where it leaves the least."""

    def __init__(self, size: int, most: int):
        self.size, self.most = size, most
        self.free: list[tuple[int, int]] = []  # (free room, window), in order
        self.held: dict[int, list] = {}
        self.made = 0

    def place(self, piece, length: int) -> list | None:
        """Take a piece; return the pieces of a window that closes, if one does."""
        out = None
        k = bisect_left(self.free, (length, -1))
        if k < len(self.free):
            room, w = self.free.pop(k)
        else:
            if len(self.free) == self.most:
                out = self.held.pop(self.free.pop(0)[1])
            room, w = self.size, self.made
            self.held[w] = []
            self.made += 1
        self.held[w].append(piece)
        if room == length:
            return self._both(out, self.held.pop(w))
        insort(self.free, (room - length, w))
        return out

    @staticmethod
    def _both(first, second):
        return second if first is None else [*first, None, *second]

    def rest(self):
        return [self.held[w] for _, w in self.free]


class _Rows:
    """Pieces on their way out, as columns."""

    def __init__(self):
        self.columns: list[list] = [[] for _ in range(7)]
        self.held = 0

    def add(self, sequence: int, pieces: list) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            for c, v in zip(self.columns, (doc, start, len(ids), ids.astype("<u4").tobytes(), total, sequence, offset), strict=True):
                c.append(v)
            offset += len(ids)
        self.held += offset

    def take(self) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        names = [x.split()[0] for x in PIECES.split(", ")]
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(self.columns, kinds, strict=True)], names)
        self.__init__()
        return out


def _groups(pieces: list):
    """Windows that closed together, one by one."""
    held: list = []
    for p in pieces:
        if p is None:
            yield held
            held = []
        else:
            held.append(p)
    yield held


def pack(docs: DataFrame, vocabulary: str, kind: str = "byte", end_id: int = 0, size: int = SEQUENCE, open_windows: int = OPEN_WINDOWS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens,
    sequence_id, offset.  Sequences are the rows of a sequence_id by offset."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), F.spark_partition_id().alias("part"))

    def stream(batches):
        enc = encoder(vocabulary, kind)
        windows, out, made, part = Windows(size, open_windows), _Rows(), 0, 0
        for batch in batches:
            texts, names = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
            if texts:
                part = batch.column("part")[0].as_py()
            for a, b in text_slices(texts):
                flat, ends = enc.encode(texts[a:b])
                flat = np.insert(flat, ends, end_id)
                ends = (ends + np.arange(1, len(ends) + 1)).tolist()
                begin = 0
                for doc, end in zip(names[a:b], ends, strict=True):
                    total = end - begin
                    whole = total // size * size
                    for at in range(0, whole, size):
                        out.add((part << 40) + made, [(doc, at, flat[begin + at : begin + at + size], total)])
                        made += 1
                    if whole < total:
                        closed = windows.place((doc, whole, flat[begin + whole : end].copy(), total), total - whole)
                        for pieces in _groups(closed) if closed else ():
                            out.add((part << 40) + made, pieces)
                            made += 1
                    begin = end
                if out.held >= 1 << 20:
                    yield out.take()
        for pieces in windows.rest():
            out.add(-1 - part, pieces)
        yield out.take()

    packed = materialise(rows.mapInArrow(stream, PIECES), "packed")
    full = packed.where("sequence_id >= 0")
    left = packed.where("sequence_id < 0").withColumn("team", F.floor((F.lit(-1) - F.col("sequence_id")) / MERGED_PARTITIONS).cast("int"))
    left = left.repartition(F.col("team")).sortWithinPartitions("team", "doc_id", "start")

    def merge(batches):
        team, sequence, room, pieces, out = None, 0, size, [], _Rows()
        for batch in batches:
            for doc, start, ids, total, t in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens", "team")), strict=True):
                if t != team:
                    if pieces:
                        out.add(sequence, pieces)
                    team, room, pieces = t, size, []
                    sequence = (1 << 62) + (t << 32)
                ids = np.frombuffer(ids, "<u4")
                while len(ids):
                    here = ids[:room]
                    pieces.append((doc, start, here, total))
                    start, room, ids = start + len(here), room - len(here), ids[len(here) :]
                    if room == 0:
                        out.add(sequence, pieces)
                        sequence, room, pieces = sequence + 1, size, []
        if pieces:
            out.add(sequence, pieces)
        yield out.take()

    return full.select(*packed.columns).unionByName(left.mapInArrow(merge, PIECES))

