"""Operator 9: near-duplicates by MinHash signatures and a multi-index Hamming join.

A text's set is its distinct 5-word shingles.  Texts of one set are one node.  A node's signature
is 84 minima under as many hash functions, cut to 16 bits each, in 14 chunks of 6 symbols.  Two
signatures that differ in at most 27 places differ in at most one place of some chunk (pigeonhole:
14 chunks with two errors each would be 28), so each chunk is entered six times into the index,
with one of its symbols left out, and every pair under that distance meets under some key.  Sets
at the similarity of 0.75 that differ in more places still meet unless all 14 chunks have two errors
or more: 2 in 100,000 such pairs do not.

No bucket is turned into all its pairs.  Each round, a node proposes the partner that looks most
like it (128 minima of 4 bits each) in another component, the links are confirmed on full sets, and
components grow; only buckets that hold several components go on.  What is left after
``ROUNDS`` is small, and there all pairs of different components that look similar enough are confirmed,
bucket by bucket in memory: the nodes that take part in such pairs are sent with their sets, never the
pairs.  A pair looks similar when its sketches agree in ``LEAST_AGREE`` places, or when its signatures differ in
``MOST_DIFFER`` places at most: no pair that the pigeonhole guarantees is refused.  In a bucket of over ``BLOCK``
nodes, the largest component is met by the blocks of all others, never by itself.

Nodes are numbered where their table is written, so no two have one number; joins whose keys may be hot
(buckets, centres, components) are split by ``join_by_key``.

Null or empty text, or no words: an empty set, linked with nothing.  Null doc_id: a document of no
group, kept.  Repeated rows, or texts of one doc_id: nodes go by their sets, so rows alike are one
class, and texts of one doc_id are told apart by their hashes; a component's id is its smallest doc_id.  Ties: of
equal partners any one is proposed, which changes no component.  Very long texts: whole, in one task.  Empty
table: an empty result.  Other columns are ignored by the report and kept by the filter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import all_columns, drop_table, free_name, hot_join, join_by_key, materialise
from .encode import forget, text_slices
from .shingles import mix, text_shingles

SHINGLE, SIMILARITY = 5, 75
CHUNKS, SYMBOLS = 14, 6
HASHES = 128
#: Least agreeing places of the 128 (of 4 bits) for a pair to be looked at: sets at 0.75 agree in 98
#: on average and in fewer than this about 3 times in 100,000.
LEAST_AGREE = 77
#: Places of the signature in which a pair may differ and meets under some key for certain.
MOST_DIFFER = 2 * CHUNKS - 1
ROUNDS = 2
#: Nodes of a block, and blocks of a bucket before blocks grow to ``LARGEST`` times that.
BLOCK, BLOCKS, LARGEST = 1024, 64, 16
#: Shingles of a block's nodes, by which a bucket of long texts is cut into more blocks.
BLOCK_SHINGLES = 4_000_000
#: Nodes whose texts are picked by a broadcast of their ids; beyond it by a sort-merge join.
BROADCAST_IDS = 200_000
#: Pairs of nodes that are compared at once.
PAIRS_AT_ONCE = 1 << 18
#: Edges of a centre that are confirmed in one task.
EDGES_AT_ONCE = 500

_rng = np.random.default_rng(0xD1CE)
_XOR = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_MUL = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_KEY = _rng.integers(0, 1 << 63, (CHUNKS, SYMBOLS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SIGNED = "digest binary, n_shingles long, signature binary, doc_id long, text_hash long"


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """HASHES minima of 16 bits for each (non-empty) set."""
    every = np.concatenate(sets)
    at = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((HASHES, len(sets)), np.uint64)
    for k in range(HASHES):
        out[k] = np.minimum.reduceat((every ^ _XOR[k]) * _MUL[k], at)
    return np.ascontiguousarray((mix(out) & np.uint64(0xFFFF)).astype(np.uint16).T)


def index_keys(signature: np.ndarray) -> np.ndarray:
    """(nodes, CHUNKS * SYMBOLS) keys: each chunk with each of its symbols left out."""
    s = signature[:, : CHUNKS * SYMBOLS].astype(np.uint64).reshape(-1, CHUNKS, SYMBOLS) + np.uint64(1)
    terms = s * _KEY
    slots = np.arange(CHUNKS * SYMBOLS, dtype=np.uint64).reshape(CHUNKS, SYMBOLS)
    return mix(terms.sum(axis=2, keepdims=True, dtype=np.uint64) - terms + slots * np.uint64(0x9E3779B97F4A7C15)).reshape(len(s), -1).view(np.int64)


def sketch(signature: np.ndarray) -> np.ndarray:
    """The low 4 bits of every symbol, sixteen to a word."""
    low = (signature & 15).astype(np.uint8)
    return (low[:, ::2] | (low[:, 1::2] << 4)).view(np.uint64)


_ONES = np.uint64(0x1111111111111111)
#: Of a sketch, the words that hold places of the signature, and the places of the last of these.
_WORDS, _REST = divmod(CHUNKS * SYMBOLS, 16)
_REST_ONES = _ONES & np.uint64((1 << (4 * _REST)) - 1)


def agree(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in which sketches agree: of all, and of those of the signature."""
    x = a ^ b
    x |= x >> np.uint64(1)
    x |= x >> np.uint64(2)
    differ = np.bitwise_count(x & _ONES)
    signature = differ[..., :_WORDS].sum(axis=-1, dtype=np.int32) + np.bitwise_count(x[..., _WORDS] & _REST_ONES)
    return HASHES - differ.sum(axis=-1, dtype=np.int32), CHUNKS * SYMBOLS - signature


def near_enough(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether signatures differ in MOST_DIFFER places at most."""
    n = CHUNKS * SYMBOLS
    return (a[:, :n] == b[:, :n]).sum(axis=1) >= n - MOST_DIFFER


def _digest(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s, digest_size=16).digest() if len(s) else None


def _sign(batches):
    forget()
    for batch in batches:
        texts, ids, hashes = (batch.column(c).to_pylist() for c in ("text", "doc_id", "text_hash"))
        for a, b in text_slices(texts):
            sets = [np.unique(s) for s in text_shingles(texts[a:b], SHINGLE)]
            full = [s for s in sets if len(s)]
            signs = iter(signatures(full).view(np.uint8).reshape(len(full), -1)) if full else iter(())
            yield pa.RecordBatch.from_pydict({
                "digest": pa.array(list(map(_digest, sets)), pa.binary()), "n_shingles": pa.array(list(map(len, sets)), pa.int64()),
                "signature": pa.array([next(signs).tobytes() if len(s) else None for s in sets], pa.binary()),
                "doc_id": pa.array(ids[a:b], pa.int64()), "text_hash": pa.array(hashes[a:b], pa.int64()),
            })


def _keys(batches):
    for batch in batches:
        n = batch.num_rows
        if n:
            signs = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint16).reshape(n, HASHES)
            keys = index_keys(signs)
            nodes = np.repeat(batch.column("node").to_numpy(zero_copy_only=False), keys.shape[1])
            slots = np.tile(np.arange(keys.shape[1], dtype=np.int8), n)
            yield pa.RecordBatch.from_pydict({"key": keys.ravel(), "slot": slots, "node": nodes})


def _sets(batches):
    """The sets of the nodes that are asked for, once for each task, of texts that have the node's digest."""
    seen: set[int] = set()
    for batch in batches:
        texts, nodes, digests = (batch.column(c).to_pylist() for c in ("text", "node", "digest"))
        for a, b in text_slices(texts):
            names, sets = [], []
            for node, digest, s in zip(nodes[a:b], digests[a:b], text_shingles(texts[a:b], SHINGLE), strict=True):
                s = np.unique(s)
                if node not in seen and _digest(s) == digest:
                    seen.add(node)
                    names.append(node)
                    sets.append(s.tobytes())
            yield pa.RecordBatch.from_pydict({"node": pa.array(names, pa.int64()), "set": pa.array(sets, pa.binary())})


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def _confirm(batches):
    """Rows sorted by centre, the centre's own set first: links that reach the similarity."""
    centre = mine = None
    for batch in batches:
        a, b, sets = (batch.column(c) for c in ("a", "b", "set"))
        out = []
        for x, y, s in zip(a.to_pylist(), b.to_pylist(), sets, strict=True):
            s = np.frombuffer(s.as_buffer(), np.uint64)
            if y is None:
                centre, mine = x, np.array(s)
            elif centre == x:
                both = _shared(mine, s)
                if 100 * both >= SIMILARITY * (len(mine) + len(s) - both):
                    out.append((x, y))
        yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of a written table whose full sets are similar; b is in one pair.  A centre's pairs are dealt
    to as many tasks as they need, each with the centre's set."""
    teams = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / EDGES_AT_ONCE).cast("int").alias("teams"))
    teams = materialise(teams, "teams")
    dealt = hot_join(pairs, teams, "a", "b", pairs.count()).withColumn("team", F.pmod(F.xxhash64("b"), F.col("teams")).cast("int")).select("a", "b", "team")
    centres = teams.select("a", F.lit(None).cast("long").alias("b"), F.explode(F.sequence(F.lit(0), F.col("teams") - 1)).alias("team"))
    rows = dealt.join(sets, F.col("b") == F.col("node")).select("a", "b", "team", "set")
    rows = rows.unionByName(centres.join(sets, F.col("a") == F.col("node")).select("a", "b", "team", "set"))
    rows = rows.repartition("a", "team").sortWithinPartitions("a", "team", F.col("b").asc_nulls_first()).select("a", "b", "set")
    found = materialise(rows.mapInArrow(_confirm, "a long, b long"), "found")
    drop_table(teams)
    return found


def components(links: DataFrame) -> DataFrame:
    """node, comp of every node in ``links``: least labels, with pointer jumping, until nothing changes.
    Labels at least halve their distance in each round, so there are about as many as the number of nodes has digits."""
    links = materialise(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = materialise(links.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("l")), "labels")
    n_links, n_labels = links.count(), labels.count()
    while True:
        near = hot_join(links, labels.withColumnRenamed("a", "b"), "b", "a", n_links).groupBy("a").agg(F.min("l").alias("m"))
        moved = labels.join(near, "a").select("a", F.col("l").alias("old"), F.least("l", "m").alias("l"))
        moved = materialise(moved, "moved")
        jump = labels.select(F.col("a").alias("l"), F.col("l").alias("ll"))
        jumped = materialise(hot_join(moved, jump, "l", "a", n_labels).select("a", F.least("l", "ll").alias("l"), "old"), "labels")
        drop_table(moved)
        drop_table(labels)
        labels = jumped
        if not labels.where("l <> old").limit(1).count():
            drop_table(links)
            return labels.select(F.col("a").alias("node"), F.col("l").alias("comp"))
        labels = labels.select("a", "l")


def grow(comps: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links; the tables of both are given up."""
    n = links.count()
    if not n:
        return comps
    ends = hot_join(links, comps.select(F.col("node").alias("a"), F.col("comp").alias("ca")), "a", "b", n)
    ends = materialise(ends.select("b", "ca"), "ends")
    both = hot_join(ends, comps.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b", "ca", n)
    both = both.where("ca <> cb").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct()
    found = components(both).select(F.col("node").alias("comp"), F.col("comp").alias("to"))
    grown = materialise(hot_join(comps, found, "comp", "node", comps.count()).select("node", F.coalesce("to", "comp").alias("comp")), "comps")
    for t in (ends, found, links, comps):
        drop_table(t)
    return grown


def _canonical(sa: np.ndarray, sb: np.ndarray) -> np.ndarray:
    """The first slot under which signatures meet."""
    same = (sa == sb)[:, : CHUNKS * SYMBOLS].reshape(-1, CHUNKS, SYMBOLS)
    good = same.sum(axis=2) >= SYMBOLS - 1
    chunk = good.argmax(axis=1)
    part = same[np.arange(len(chunk)), chunk]
    return chunk * SYMBOLS + np.where(part.all(axis=1), 0, (~part).argmax(axis=1))


def _pairs_of(unit: dict, every: bool):
    """Places of similar-looking pairs of different components of one bucket, or of two of its blocks: for each
    node the nearest, or all (each in the first bucket that has it)."""
    node, comp, block, size, signs = (unit[c] for c in ("node", "comp", "block", "n_shingles", "signature"))
    looks = sketch(signs)
    names, inverse, counts = np.unique(comp, return_inverse=True, return_counts=True)
    small = np.flatnonzero(inverse != counts.argmax())
    rank = np.full(len(node), -1)
    rank[small] = np.arange(len(small))
    two = unit["u"] != unit["v"]
    step = max(1, PAIRS_AT_ONCE // len(node))
    for k in range(0, len(small), step):
        rows = small[k : k + step]
        same, signed = agree(looks[rows][:, None], looks[None])
        ok = inverse[rows][:, None] != inverse[None]
        ok &= 100 * np.minimum(size[rows][:, None], size[None]) >= SIMILARITY * np.maximum(size[rows][:, None], size[None])
        if two:
            ok &= block[rows][:, None] != block[None]
        if every:
            ok &= rank[None] < rank[rows][:, None]
        # what looks unlike but may be near enough by the signature is measured by it
        i, j = np.nonzero(ok & (same < LEAST_AGREE) & (signed >= CHUNKS * SYMBOLS - MOST_DIFFER))
        ok &= same >= LEAST_AGREE
        if len(i):
            ok[i, j] = near_enough(signs[rows[i]], signs[j])
        if every:
            i, j = np.nonzero(ok)
            i = rows[i]
            if len(i):
                first = _canonical(signs[i], signs[j]) == unit["slot"]
                i, j = i[first], j[first]
            yield i, j, np.zeros(len(i), np.int32)
        else:
            same = np.where(ok, same, -1)
            j = same.argmax(axis=1)
            best = same[np.arange(len(rows)), j]
            rows, j, best = rows[best >= 0], j[best >= 0], best[best >= 0]
            yield rows, j, best.astype(np.int32)


def _units(work):
    """A function of batches sorted by (key, u, v) that calls ``work`` with the columns of each unit."""

    def run(batches):
        held: list = []
        unit = None

        def close():
            t = pa.Table.from_batches(held).combine_chunks()
            n = t.num_rows
            if n < 2:
                return
            one = {c: t.column(c).to_numpy() for c in ("node", "comp", "block", "n_shingles")}
            one["signature"] = np.frombuffer(b"".join(t.column("signature").to_pylist()), np.uint16).reshape(n, HASHES)
            one |= {c: t.column(c)[0].as_py() for c in ("key", "slot", "u", "v")}
            if "set" in t.column_names:
                one["set"] = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("set")]
            yield from work(one)

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            marks = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "u", "v")]
            cuts = np.flatnonzero(np.any([m[1:] != m[:-1] for m in marks], axis=0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), n], strict=True):
                name = tuple(m[a] for m in marks)
                if name != unit and held:
                    yield from close()
                    held = []
                unit = name
                held.append(batch.slice(a, b - a))
        if held:
            yield from close()

    return run


def _nearest(unit):
    for i, j, agree in _pairs_of(unit, False):
        if len(i):
            yield pa.RecordBatch.from_pydict({"a": unit["node"][i], "b": unit["node"][j], "agree": agree})


def _partakers(unit):
    """The rows of a unit that take part in any of its pairs."""
    some = np.zeros(len(unit["node"]), bool)
    for i, j, _ in _pairs_of(unit, True):
        some[i] = some[j] = True
    if some.any():
        n = int(some.sum())
        yield pa.RecordBatch.from_pydict(
            {c: pa.array(np.full(n, unit[c], k)) for c, k in (("key", np.int64), ("slot", np.int8), ("u", np.int32), ("v", np.int32))} | {c: unit[c][some] for c in ("node", "comp", "block")}
        )


def _confirm_unit(unit):
    """Links of a unit on full sets; components that a link has joined are compared no more."""
    comp, sets, of = unit["comp"], unit["set"], {}

    def root(c):
        while of.setdefault(c, c) != c:
            of[c] = c = of[of[c]]
        return c

    found = []
    for i, j, _ in _pairs_of(unit, True):
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            cx, cy = root(int(comp[x])), root(int(comp[y]))
            if cx != cy:
                both = _shared(sets[x], sets[y])
                if 100 * both >= SIMILARITY * (len(sets[x]) + len(sets[y]) - both):
                    of[cx] = cy
                    found.append((x, y))
    if found:
        x, y = np.array(found).T
        yield pa.RecordBatch.from_pydict({"a": unit["node"][x], "b": unit["node"][y]})


def _blocks(n: str, s: str) -> Column:
    """Blocks for n nodes with s shingles."""
    few = F.least(F.ceil(F.col(n) / BLOCK), F.lit(BLOCKS))
    return F.greatest(few, F.ceil(F.col(n) / (BLOCK * LARGEST)), F.ceil(F.col(s) / BLOCK_SHINGLES)).cast("int")


def _open_units(members: DataFrame, comps: DataFrame, signs: DataFrame) -> DataFrame | None:
    """Rows of the buckets that hold several components, dealt into units of two blocks at most; None when no
    bucket does.

    A bucket that is no larger than a block is one unit.  Of others, the nodes outside the largest component
    make blocks that meet each other and the blocks of the largest component, which never meet themselves."""
    rows = materialise(members.join(comps.join(signs.select("node", "n_shingles"), "node"), "node"), "members")
    sizes = rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("s"))
    open_ = sizes.groupBy("key").agg(F.count(F.lit(1)).alias("comps"), F.sum("n").alias("n_rows"), F.sum("s").alias("s"), F.max(F.struct("n", "s", "comp")).alias("top")).where("comps > 1")
    open_ = open_.select("key", "n_rows", "s", F.col("top.comp").alias("top"), F.col("top.n").alias("n_top"), F.col("top.s").alias("s_top"))
    open_ = open_.withColumns({"n_rest": F.col("n_rows") - F.col("n_top"), "s_rest": F.col("s") - F.col("s_top")})
    one = _blocks("n_rows", "s") == 1
    rest, top = F.when(one, 0).otherwise(_blocks("n_rest", "s_rest")), F.when(one, 0).otherwise(_blocks("n_top", "s_top"))
    open_ = materialise(open_.select("key", "n_rows", "top", rest.alias("rest_blocks"), top.alias("top_blocks")), "open")
    if open_.isEmpty():
        return None
    dealt = join_by_key(rows.drop("n_shingles"), open_, "key", rows.count(), "node").where("n_rows IS NOT NULL")
    in_top = F.col("comp") == F.col("top")
    mine = F.when(F.col("rest_blocks") == 0, 0).when(in_top, F.col("rest_blocks") + F.pmod(F.xxhash64("node"), F.col("top_blocks"))).otherwise(F.pmod(F.xxhash64("node"), F.col("rest_blocks")))
    last = F.when(F.col("rest_blocks") == 0, 0).when(in_top, F.col("rest_blocks") - 1).otherwise(F.col("rest_blocks") + F.col("top_blocks") - 1)
    dealt = dealt.select("key", "slot", "node", "comp", mine.cast("int").alias("block"), last.cast("int").alias("last"))
    dealt = dealt.join(signs, "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
    dealt = dealt.select("key", "slot", F.least("block", "other").alias("u"), F.greatest("block", "other").alias("v"), "node", "comp", "block", "n_shingles", "signature")
    return dealt.repartition("key", "u", "v").sortWithinPartitions("key", "u", "v")


def propose(units: DataFrame) -> DataFrame:
    """For each node outside the largest component of an open bucket, the nearest of another: a, b, agree."""
    return units.mapInArrow(_units(_nearest), "a long, b long, agree int")


def settle(units: DataFrame, signs: DataFrame, sets: DataFrame) -> DataFrame:
    """Links a, b out of all similar-looking pairs of different components in open buckets."""
    some = units.mapInArrow(_units(_partakers), "key long, slot byte, u int, v int, node long, comp long, block int")
    some = materialise(some, "partakers").join(signs, "node").join(sets, "node")
    return some.repartition("key", "u", "v").sortWithinPartitions("key", "u", "v").mapInArrow(_units(_confirm_unit), "a long, b long")


def _agree_of(batches):
    for batch in batches:
        n = batch.num_rows
        if n:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(n, HASHES) for c in ("sa", "sb"))
            same, _ = agree(sketch(a), sketch(b))
            ok = (same >= LEAST_AGREE) | near_enough(a, b)
            yield pa.RecordBatch.from_pydict({"a": batch.column("a").filter(pa.array(ok)), "b": batch.column("b").filter(pa.array(ok)), "agree": pa.array(same[ok], pa.int32())})


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (digest, n_shingles, doc_id, text_hash) and classes (node, digest, n_shingles, signature, rep, n_rows)."""
    signed = materialise(_texts(docs).mapInArrow(_sign, _SIGNED), "signed")
    rows = signed.drop("signature")
    some = signed.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    classes = some.groupBy("digest").agg(
        F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"), F.min(F.struct("doc_id", "text_hash")).alias("rep"), F.count(F.lit(1)).alias("n_rows")
    )
    # numbers that are unique in the table as it is written, at any size
    return rows, materialise(classes.withColumn("node", F.monotonically_increasing_id()), "classes")


def _node_sets(docs: DataFrame, classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, set of the nodes, each once, from one text of each."""
    few = nodes.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    picked = classes.join(nodes, "node", "left_semi").select("rep.doc_id", "rep.text_hash", "node", "digest")
    texts = _texts(docs).join(F.broadcast(picked) if few else picked, ["doc_id", "text_hash"]).select("node", "digest", "text")
    sets = materialise(texts.mapInArrow(_sets, "node long, set binary"), "sets")
    if sets.groupBy("node").count().where("count > 1").limit(1).count():  # rows alike, in several tasks
        sets = materialise(sets.groupBy("node").agg(F.first("set").alias("set")), "sets")
    return sets


def near_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows as above, and digest, n_rows, component_id, keep_hash of every class: the smallest doc_id of its
    component, and the hash of that row's text."""
    rows, classes = _classes(docs)
    signs = classes.select("node", "n_shingles", "signature")
    keys = signs.select("node", "signature").mapInArrow(_keys, "key long, slot byte, node long")
    buckets = keys.groupBy("key").agg(F.min("node").alias("centre"), F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")
    buckets = materialise(buckets, "buckets")
    members = join_by_key(keys, buckets, "key", CHUNKS * SYMBOLS * classes.count(), "node").where("n_rows IS NOT NULL")
    members = materialise(members.drop("n_rows"), "members")
    nodes = materialise(members.select("node").distinct(), "nodes")
    sets = _node_sets(docs, classes, nodes)

    comps = materialise(nodes.withColumn("comp", F.col("node")), "comps")
    stars = materialise(members.where("centre <> node").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct(), "stars")
    looks = hot_join(stars, signs.select(F.col("node").alias("a"), F.col("signature").alias("sa")), "a", "b", stars.count())
    looks = looks.join(signs.select(F.col("node").alias("b"), F.col("signature").alias("sb")), "b")
    looks = looks.select("a", "b", "sa", "sb").mapInArrow(_agree_of, "a long, b long, agree int")
    best = materialise(looks.groupBy("b").agg(F.max(F.struct("agree", "a")).alias("m")).select(F.col("m.a").alias("a"), "b"), "pairs")
    comps = grow(comps, confirm(best, sets))
    members = members.select("key", "slot", "node")
    for last in (*[False] * (ROUNDS - 1), True):
        units = _open_units(members, comps, signs)
        if units is None:
            break
        if last:
            comps = grow(comps, materialise(settle(units, signs, sets), "found"))
        else:
            near = propose(units).groupBy("a").agg(F.max(F.struct("agree", "b")).alias("m")).select(F.col("m.b").alias("a"), F.col("a").alias("b"))
            comps = grow(comps, confirm(materialise(near, "pairs"), sets))

    known = materialise(classes.select("digest", "node", "rep", "n_rows").join(comps, "node", "left"), "known")
    linked = known.where("comp IS NOT NULL").withColumnRenamed("n_rows", "n_copies")
    least = linked.groupBy("comp").agg(F.min("rep").alias("least"), F.count(F.lit(1)).alias("n_rows"))
    linked = join_by_key(linked, least, "comp", linked.count(), "node").select("digest", F.col("n_copies").alias("n_rows"), F.col("least").alias("rep"))
    named = known.where("comp IS NULL").select("digest", "n_rows", "rep").unionByName(linked)
    named = materialise(named.select("digest", "n_rows", F.col("rep.doc_id").alias("component_id"), F.col("rep.text_hash").alias("keep_hash")), "named")
    for t in (classes, sets, stars, best, members, nodes, buckets, known):
        drop_table(t)
    return rows, named


def near_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    rows, named = near_classes(docs)
    total = rows.count()
    rows = rows.withColumn("digest", F.when(F.col("doc_id").isNotNull(), F.col("digest")))
    out = join_by_key(rows, named.drop("keep_hash"), "digest", total, F.struct("doc_id", "n_shingles"))
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id").isNull() | (F.col("doc_id") == component)).alias("kept"))


def keep_representatives(docs: DataFrame) -> DataFrame:
    """One document of each group, with the columns of ``docs``; rows without words or doc_id all stay.
    Of rows alike in doc_id and text that stay, one does."""
    i, h, mine = (free_name(docs, c) for c in ("kept_id", "kept_hash", "text_hash"))
    _, named = near_classes(docs)
    kept = named.select(F.col("component_id").alias(i), F.col("keep_hash").alias(h)).distinct()
    wordless = F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]") == F.lit(False)
    free = docs.where(F.col("doc_id").isNull() | wordless)
    rows = docs.where(F.col("doc_id").isNotNull() & ~wordless).withColumn(mine, F.xxhash64("text"))
    rows = rows.join(kept, (rows["doc_id"].cast("long") == kept[i]) & (rows[mine] == kept[h]))
    return rows.dropDuplicates([i, h]).select(*all_columns(docs)).unionByName(free)


#: The report in SQL, for checks on small tables: all pairs that share a shingle.
REPORT_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS gram
  FROM w WHERE len(words) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS node, doc_id AS root FROM n UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node WHERE r.root < l.b),
c AS (SELECT node, min(root) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id, d.doc_id = coalesce(c.component_id, d.doc_id) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.node = d.doc_id
"""
