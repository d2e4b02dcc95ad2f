"""Operator 1: token ids in files of directly addressable codes.

An id is cut into chunks of 8 bits, the lowest first.  Level j holds the j-th chunk of every id
that has one; beside it a bitmap says which chunks are continued on level j + 1, and a rank
directory counts the set bits before each block of 512, so that the place of any id's next
chunk is one directory entry and at most eight popcounts away.  Any id, or run of ids, is read
without decoding those before it.

A segment holds whole documents, about ``SEGMENT_IDS`` ids of them, with its document table, as
one blob.  Blobs are rows of a Parquet table that Spark's committer writes, so a lost executor
leaves no half-written file, and any store that Spark reads will do.  Rows of the table follow
ascending (doc_id, hash of the text): partition by partition, segment by segment.

Null or empty text: no ids but the end id.  Null doc_id: first.  Repeated doc_ids or rows: each is
a document of its own, ties in the order of their texts' hashes.  Very long texts: encoded whole, in a segment
of their own size.  Empty table: an empty file.  Other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path
from .encode import encoder, text_slices

MAGIC = b"DAC1"
#: Bits between entries of a rank directory.
BLOCK = 512
#: A segment is closed when it has so many ids.
SEGMENT_IDS = 1 << 20
SEGMENTS = "part int, segment long, n_docs long, n_ids long, blob binary"


def pack_segment(doc_ids: list[int | None], ends: np.ndarray, ids: np.ndarray) -> bytes:
    """A blob of ``ids``; ``ends`` has the end of each document's ids."""
    levels = []
    rest = ids.astype(np.uint64)
    while True:
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate((bits, np.zeros(-len(bits) % (BLOCK // 8) + 8, np.uint8)))
        per_block = np.bitwise_count(bits[: len(bits) // 64 * 64].reshape(-1, BLOCK // 8)).sum(axis=1, dtype=np.uint64)
        ranks = np.concatenate(([0], np.cumsum(per_block))).astype("<u8")
        levels.append((len(rest), (rest & np.uint64(255)).astype(np.uint8).tobytes(), bits.tobytes(), ranks.tobytes()))
        if not more.any():
            break
        rest = rest[more] >> np.uint64(8)
    head = struct.pack("<4sHHQQ", MAGIC, 1, len(levels), len(doc_ids), len(ids))
    names = np.array([-1 if d is None else d for d in doc_ids], "<i8").tobytes()
    nulls = np.packbits(np.array([d is None for d in doc_ids], bool), bitorder="little").tobytes()
    sizes = b"".join(struct.pack("<QQQQ", n, len(c), len(b), len(r)) for n, c, b, r in levels)
    return b"".join([head, sizes, names, nulls, ends.astype("<u8").tobytes(), *(x for lv in levels for x in lv[1:])])


class Segment:
    """Random access to a blob."""

    def __init__(self, blob: bytes):
        magic, version, n_levels, n_docs, self.n_ids = struct.unpack_from("<4sHHQQ", blob)
        if magic != MAGIC or version != 1:
            raise ValueError("not a token segment of this version")
        at = struct.calcsize("<4sHHQQ")
        sizes = [struct.unpack_from("<QQQQ", blob, at + 32 * k) for k in range(n_levels)]
        at += 32 * n_levels

        def take(kind, n):
            nonlocal at
            out = np.frombuffer(blob, kind, n, at)
            at += out.nbytes
            return out

        names, nulls = take("<i8", n_docs), take(np.uint8, (n_docs + 7) // 8)
        nulls = np.unpackbits(nulls, count=n_docs, bitorder="little").astype(bool)
        self.doc_ids = [None if z else int(d) for d, z in zip(names, nulls, strict=True)]
        self.ends = take("<u8", n_docs).astype(np.int64)
        self.levels = [(take(np.uint8, c), take(np.uint8, b), take("<u8", r // 8)) for _, c, b, r in sizes]

    @staticmethod
    def _rank(bits, ranks, at: np.ndarray) -> np.ndarray:
        """Set bits before each of the positions ``at``: a directory entry and the rest of its block."""
        block = at // BLOCK
        out = ranks[block].astype(np.int64)
        words = bits[: len(bits) // 8 * 8].view("<u8")
        for k in range(BLOCK // 64):
            word = block * (BLOCK // 64) + k
            held = np.clip(at - word * 64, 0, 64)
            mask = np.where(held == 64, np.uint64(2**64 - 1), (np.uint64(1) << np.minimum(held, 63).astype(np.uint64)) - np.uint64(1))
            out += np.bitwise_count(words[np.minimum(word, len(words) - 1)] & mask)
        return out

    def get(self, positions) -> np.ndarray:
        """The ids at any positions, each found by itself."""
        at = np.asarray(positions, np.int64)
        if len(at) and (at.min() < 0 or at.max() >= self.n_ids):
            raise IndexError("no such position")
        out, which = np.zeros(len(at), np.uint64), np.arange(len(at))
        for k, (chunks, bits, ranks) in enumerate(self.levels):
            out[which] |= chunks[at].astype(np.uint64) << np.uint64(8 * k)
            more = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            which, at = which[more], self._rank(bits, ranks, at[more])
        return out

    def run(self, first: int, last: int) -> np.ndarray:
        """The ids first..last-1: one slice of each level, found by rank."""
        out, which = np.zeros(last - first, np.uint64), slice(None)
        for k, (chunks, bits, ranks) in enumerate(self.levels):
            if first >= last:
                break
            out[which] |= chunks[first:last].astype(np.uint64) << np.uint64(8 * k)
            byte = first >> 3
            flags = np.unpackbits(bits[byte : (last + 7) >> 3], bitorder="little")[first - 8 * byte :][: last - first]
            which = np.flatnonzero(flags) if k == 0 else which[flags == 1]
            first, last = (int(self._rank(bits, ranks, np.array([x]))[0]) for x in (first, last))
        return out

    def documents(self):
        """(doc_id, ids) of every document in order; the segment is read once as a whole."""
        ids, start = self.run(0, self.n_ids), 0
        for doc, end in zip(self.doc_ids, self.ends.tolist(), strict=True):
            yield doc, ids[start:end]
            start = end


def write_tokens(docs: DataFrame, path: str, vocabulary: str, kind: str = "word", end_id: int = 2, partitions: int | None = None, segment_ids: int = SEGMENT_IDS) -> None:
    """Encode ``doc_id, text`` and write the segments to ``path``."""
    spark = docs.sparkSession
    n = partitions or max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text")).repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h")
    rows = rows.select("doc_id", "text", F.spark_partition_id().alias("part"))

    def write(batches):
        enc = encoder(vocabulary, kind)
        part, segment = 0, 0
        names: list[int | None] = []
        held: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        count = 0

        def close():
            nonlocal segment, count, names, held, sizes
            blob = pack_segment(names, np.cumsum(np.concatenate(sizes)), np.concatenate(held))
            out = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "segment": [segment], "n_docs": [len(names)], "n_ids": [count], "blob": pa.array([blob], pa.binary())})
            segment, count, names, held, sizes = segment + 1, 0, [], [], []
            return out

        for batch in batches:
            texts, docs_here = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
            if len(texts):
                part = batch.column("part")[0].as_py()
            for a, b in text_slices(texts):
                ids, ends = enc.encode(texts[a:b])
                held.append(np.insert(ids, ends, end_id))
                sizes.append(np.diff(ends, prepend=0) + 1)
                names += docs_here[a:b]
                count += len(held[-1])
                if count >= segment_ids:
                    yield close()
        if names:
            yield close()

    rows.mapInArrow(write, SEGMENTS).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32, part, segment.

    Where a partition's ids start is the sum of those before it: one row per partition of the
    file comes to the driver, however many documents there are."""
    segments = spark.read.schema(SEGMENTS).parquet(path)
    totals = sorted(segments.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    bases, start = [], 0
    for part, n in totals:
        bases.append((part, start))
        start += n
    bases = spark.createDataFrame(bases, "part int, part_start long")
    from pyspark.sql import Window

    order = Window.partitionBy("part").orderBy("segment")
    starts = segments.select("part", "segment", "n_ids").join(F.broadcast(bases), "part")
    starts = starts.select("part", "segment", (F.col("part_start") + F.sum("n_ids").over(order) - F.col("n_ids")).alias("base"))

    def read(batches):
        for batch in batches:
            for part, segment, blob in zip(batch.column("part").to_pylist(), batch.column("segment").to_pylist(), batch.column("blob"), strict=True):
                s = Segment(blob.as_py())
                crcs = [zlib.crc32(ids.astype("<u4")) for _, ids in s.documents()]
                sizes = np.diff(s.ends, prepend=0)
                n = len(s.doc_ids)
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array(np.full(n, part, np.int32)), "segment": pa.array(np.full(n, segment, np.int64)), "doc_id": pa.array(s.doc_ids, pa.int64()),
                    "at": pa.array(s.ends - sizes), "n_tokens": pa.array(sizes), "ids_crc32": pa.array(crcs, pa.int64()),
                })

    found = segments.select("part", "segment", "blob").mapInArrow(read, "part int, segment long, doc_id long, at long, n_tokens long, ids_crc32 long")
    out = found.join(starts, ["part", "segment"])
    return out.select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "part", "segment")


def token_file(docs: DataFrame, vocabulary: str, kind: str = "word", end_id: int = 2) -> DataFrame:
    """Write the file to the shared folder and read it back."""
    path = scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, vocabulary, kind, end_id)
    return read_tokens(docs.sparkSession, path)
