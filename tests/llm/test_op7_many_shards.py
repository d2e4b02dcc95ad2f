"""Jump consistent hashing for numbers of shards at which few jumps are enough for nearly all keys."""

import pytest
from pyspark.sql import functions as F

from sparrel.llm import sharding


def jump(key, shards):
    b, j = -1, 0
    key &= 2**64 - 1
    while j < shards:
        b = j
        key = (key * sharding.MULTIPLIER + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("shards", [1, 2, 40, 41, 5000])
def test_many_shards(spark, shards, monkeypatch):
    keys = spark.range(300).select(((F.col("id") - 100) * 7_777_777_777_777).alias("key"))
    got = keys.select("key", *[c.alias(n) for c, n in zip(sharding.jump_hash(F.col("key"), shards), ("now", "grown"), strict=True)]).collect()
    assert all(g["now"] == jump(g["key"], shards) and g["grown"] == jump(g["key"], shards + 1) for g in got)


def test_slot_buckets(spark):
    docs = spark.range(500).selectExpr("id as doc_id", "if(id % 3 = 0, 'same', concat('t', id)) as text")
    for buckets in (1, 8, 1024):
        got = sharding.shard(docs, 3, buckets).collect()
        for s in range(3):
            slots = sorted(g["slot"] for g in got if g["shard"] == s)
            assert slots == [*range(len(slots))]
