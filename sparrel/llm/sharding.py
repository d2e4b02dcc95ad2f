"""Operator 7: sharding by jump consistent hashing (Lamping and Veach, 2014).

The shard is a function of doc_id and the number of shards alone; no ring or table is kept, and
one more shard takes rows only into itself.  The generator key * 2862933555777941757 + 1 modulo
2**64 is worked on two halves of 32 bits, so that no product overflows under ANSI arithmetic.

Null text: size 1 and the crc of nothing.  Null doc_id: the text's crc is the key.  Repeated
rows (ties): all in one shard, in slots that follow one another, whichever first.  Very long texts: only their
size and crc are used.  Empty table: an empty result.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import free_name

#: The multiplier of the generator, and the buckets that slots are counted in by default.
MULTIPLIER = 2862933555777941757
SLOT_BUCKETS = 256
_LOW = 0xFFFFFFFF


def _step(high: Column, low: Column) -> tuple[Column, Column]:
    """high and low half of the next key."""
    a_high, a_low = MULTIPLIER >> 32, MULTIPLIER & _LOW

    def low_product(x: Column, a: int) -> Column:
        return ((x * F.lit(a & 0xFFFF)).bitwiseAND(F.lit(_LOW)) + F.shiftleft((x * F.lit(a >> 16)).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(_LOW))

    p = low * F.lit(a_low & 0xFFFF) + F.lit(1)
    q = low * F.lit(a_low >> 16)
    sum_low = p + F.shiftleft(q.bitwiseAND(F.lit(0xFFFF)), 16)
    carry = F.shiftright(sum_low, 32) + F.shiftright(q, 16)
    return (carry + low_product(high, a_low) + low_product(low, a_high)).bitwiseAND(F.lit(_LOW)), sum_low.bitwiseAND(F.lit(_LOW))


def jump_hash(key: Column, shards: int) -> tuple[Column, Column]:
    """The bucket of a 64-bit key among ``shards``, and among one more."""
    state = F.struct(
        F.shiftrightunsigned(key, 32).bitwiseAND(F.lit(_LOW)).alias("high"), key.bitwiseAND(F.lit(_LOW)).alias("low"),
        F.lit(-1).cast("long").alias("bucket"), F.lit(0).cast("long").alias("next"),
    )

    def jump(s: Column, _: Column) -> Column:
        high, low = _step(s["high"], s["low"])
        ratio = F.lit(float(1 << 31)) / (F.shiftright(high, 1) + F.lit(1)).cast("double")
        moved = F.struct(high.alias("high"), low.alias("low"), s["next"].alias("bucket"), F.floor((s["next"] + F.lit(1)).cast("double") * ratio).cast("long").alias("next"))
        return F.when(s["next"] < F.lit(shards), moved).otherwise(s)

    # a key jumps about ln(shards) times and hardly ever more than ``most``; the rest of the way is for those that do
    most = min(shards, 16 + 4 * shards.bit_length())
    end = F.aggregate(F.sequence(F.lit(1), F.lit(most)), state, jump)
    if most < shards:
        last = F.sequence(F.lit(most + 1), F.lit(shards))
        end = F.transform(F.array(end), lambda s: F.when(s["next"] >= F.lit(shards), s).otherwise(F.aggregate(last, s, jump)))[0]
    return end["bucket"].cast("int"), F.when(end["next"] == F.lit(shards), F.lit(shards)).otherwise(end["bucket"]).cast("int")


def shard(docs: DataFrame, shards: int = 16, slot_buckets: int = SLOT_BUCKETS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row.

    Slots are counted in two steps: rows of each (shard, bucket of doc_id and text), then a running
    sum over those shards * ``slot_buckets`` (a power of two) counts, a table of fixed size.  No shard meets in one task,
    nor do the rows of one doc_id or of one text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = rows.withColumn("key", F.coalesce(F.col("doc_id").cast("long"), F.col("text_crc32")))
    bucket, grown = jump_hash(F.col("key"), shards)
    rows = rows.withColumn("b", F.col("key").bitwiseXOR(F.col("text_crc32")).bitwiseAND(F.lit(slot_buckets - 1)).cast("int"))
    rows = rows.withColumn("j", F.struct(bucket.alias("shard"), grown.alias("grown_shard")))
    rows = rows.select("doc_id", "size", "text_crc32", "b", "j.shard", "j.grown_shard")
    counts = rows.groupBy("shard", "b").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("b")
    bases = counts.select("shard", "b", (F.sum("n").over(before) - F.col("n")).alias("base"))
    within = Window.partitionBy("shard", "b").orderBy("doc_id", "text_crc32", "size")
    out = rows.withColumn("k", F.row_number().over(within)).join(F.broadcast(bases), ["shard", "b"])
    slot = F.col("base") + F.col("k") - F.lit(1)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", slot.alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int = 16) -> None:
    """All columns of ``docs`` into folders shard=0.. below ``path``."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
    docs.withColumn(free_name(docs, "shard"), jump_hash(key, shards)[0]).write.partitionBy(free_name(docs, "shard")).parquet(path)


#: The report in SQL for 16 shards.  A crc is linear: it is the sum (XOR) of what each byte gives, and a byte
#: that k others follow gives its own crc moved on by k zero bytes; bytes are summed in blocks of 128, and
#: moves by whole blocks are 32 images of single bits.
SHARD_SQL = r"""
WITH RECURSIVE
s AS (SELECT 0 AS t, CAST(1 AS BIGINT) AS v UNION ALL SELECT t + 1, xor(v >> 1, (v & 1) * 3988292384) FROM s WHERE t < 1024),
z AS (SELECT t, v FROM s UNION ALL SELECT CAST(-u AS INT), CAST(1 AS BIGINT) << CAST(u AS BIGINT) FROM range(1, 32) AS x(u)),
y AS (SELECT upper(printf('%02x', CAST(byte AS INT))) AS h, CAST(k AS INT) AS k, coalesce(bit_xor(z.v), 0) AS v
  FROM range(256) AS x(byte) CROSS JOIN range(128) AS p(k) CROSS JOIN range(8) AS j(bit) LEFT JOIN z ON z.t = 8 * k + 8 - bit AND (byte >> bit) & 1 = 1 GROUP BY byte, k),
d AS (SELECT row_number() OVER () AS r, doc_id, strlen(coalesce(text, '')) AS n, regexp_extract_all(hex(coalesce(text, '')), '..') AS bytes FROM documents),
one AS (SELECT list(v ORDER BY t DESC) AS m FROM z WHERE t > 992),
move AS (
  SELECT CAST(0 AS BIGINT) AS q, m, list_transform(range(32), lambda b: CAST(1 AS BIGINT) << b) AS images FROM one
  UNION ALL SELECT q + 1, m, list_transform(images, lambda w: list_bit_xor(list_transform(range(32), lambda c: CASE WHEN (w >> c) & 1 = 1 THEN m[c + 1] ELSE 0 END)))
  FROM move WHERE q <= (SELECT max(n) // 128 FROM d)),
part AS (
  SELECT r, (n - i) // 128 AS q, y.v FROM (SELECT r, n, unnest(bytes) AS h, unnest(range(1, n + 1)) AS i FROM d) AS e JOIN y ON y.h = e.h AND y.k = (n - i) % 128
  UNION ALL SELECT r, greatest(8 * n - b, 0) // 1024, z.v FROM d CROSS JOIN range(32) AS x(b) JOIN z ON z.t = 8 * n - b - 1024 * (greatest(8 * n - b, 0) // 1024)),
block AS (SELECT r, q, bit_xor(v) AS v FROM part GROUP BY r, q),
c AS (
  SELECT r, xor(bit_xor(list_bit_xor(list_transform(range(32), lambda b: CASE WHEN (v >> b) & 1 = 1 THEN images[b + 1] ELSE 0 END))), 4294967295) AS crc
  FROM block JOIN move USING (q) GROUP BY r),
k AS (SELECT d.r, doc_id, n + 1 AS size, c.crc, coalesce(doc_id, c.crc) AS key FROM d JOIN c ON c.r = d.r),
j AS (
  SELECT r, CASE WHEN key < 0 THEN CAST(key AS HUGEINT) + 18446744073709551616 ELSE CAST(key AS HUGEINT) END AS state, CAST(-1 AS BIGINT) AS bucket, CAST(0 AS BIGINT) AS next FROM k
  UNION ALL SELECT r, state, next, CAST(floor((next + 1) * (CAST(2147483648 AS DOUBLE) / CAST(state // 8589934592 + 1 AS DOUBLE))) AS BIGINT)
  FROM (SELECT r, (state * 2862933555777941757 + 1) % CAST(18446744073709551616 AS HUGEINT) AS state, next FROM j WHERE next < 16) AS moved)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'key' AS law, CAST(bucket AS INT) AS shard,
  row_number() OVER (PARTITION BY bucket ORDER BY xor(key, crc) & 255, doc_id NULLS FIRST, crc, size) - 1 AS slot, CAST(CASE WHEN next = 16 THEN 16 ELSE bucket END AS INT) AS grown_shard
FROM k JOIN j ON j.r = k.r AND j.next >= 16
"""
